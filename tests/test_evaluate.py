"""Metrics, summaries, agreement, build planning, pools."""

import pytest
from pyspark.sql import functions as F

from glintframe.functions import tags as T
from glintframe.operators import build as B
from glintframe.operators import evaluate as E
from glintframe.plans import catalogs


def test_tag_predicates(spark):
    q_any, q_no = F.array(F.array(F.lit("city"), F.lit("urban")), F.array(F.lit("night"))), F.array(F.lit("car"))
    rows = [(["city", "night"], True), (["city"], False), (["urban", "night", "car"], False), (None, False)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "tags array<string>")
    got = [r[0] for r in df.select(T.is_positive(F.col("tags"), F.array().cast("array<string>"), q_any, q_no)).collect()]
    assert got == [x for _, x in rows]
    row = spark.range(1).select(T.parse_tags(F.lit(" Red, blue,,red ,x-y ")).alias("t"), T.query_text(F.lit("x-y")).alias("q"), T.parse_tags(F.lit(None).cast("string")).alias("n"), T.default_kind(F.lit(None).cast("string"), q_no).alias("k")).first()
    assert row["t"] == ["red", "blue", "x-y"] and row["q"] == "x y" and row["n"] is None and row["k"] == "negation"


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, True, True, False), (1, 2, False, True, True), (1, 3, False, False, False), (2, 1, False, None, None)], "query_id int, rank int, relevant boolean, required boolean, forbidden boolean")
    judged = spark.createDataFrame([(1, 1, 3), (2, 0, 1), (3, 2, 0)], "query_id int, positives int, returned int")
    got = {r["query_id"]: r.asDict() for r in E.retrieval_metrics(ranked, judged, 3).collect()}
    assert got[1]["precision_at_k"] == pytest.approx(1 / 3) and got[1]["required_at_k"] == pytest.approx(2 / 3) and got[1]["forbidden_at_k"] == pytest.approx(1 / 3)
    assert all(got[1][m] == pytest.approx(1) for m in ("recall_at_k", "average_precision_at_k", "ndcg_at_k", "reciprocal_rank"))
    assert all(got[q][m] == 0 for q in (2, 3) for m in E.METRICS if m not in ("required_at_k", "forbidden_at_k"))
    means = E.mean_metrics(E.retrieval_metrics(ranked, judged, 3).withColumn("kind", F.lit("k")), "kind").collect()
    assert {r["kind"]: r["queries"] for r in means} == {"k": 2, None: 2}


def test_average_precision(spark):
    ranked = spark.createDataFrame([(1, i + 1, h, h, False) for i, h in enumerate([False, True, True, False])], "query_id int, rank int, relevant boolean, required boolean, forbidden boolean")
    judged = spark.createDataFrame([(1, 2, 4)], "query_id int, positives int, returned int")
    assert E.retrieval_metrics(ranked, judged, 4).first()["average_precision_at_k"] == pytest.approx((1 / 2 + 2 / 3) / 2)


def test_percentiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double")
    row = df.agg(E.percentile_nearest("v", 0.95).alias("n"), E.percentile_nearest("v", 0).alias("z"), E.percentile_linear("v", 0.5).alias("l")).first()
    assert (row["n"], row["z"], row["l"]) == (4.0, 4.0, 2.5)


def test_rerank(spark):
    tags = [["road", "car"], ["road"], ["truck"], ["forest"]]
    df = spark.createDataFrame([(1, r + 1, i, tags[i]) for r, i in enumerate([2, 0, 3, 1])], "query_id int, rank int, item int, tags array<string>")
    kept = E.rerank(df, ~T.has_forbidden(F.col("tags"), F.array(F.lit("car"), F.lit("truck")))).orderBy("rank").collect()
    assert [(r["rank"], r["item"]) for r in kept] == [(1, 3), (2, 1)]


def test_anchor_summary(spark):
    r = E.anchor_summary(spark.createDataFrame([(1, 2.0), (4, 4.0), (20, 6.0)], "rank int, query_ms double")).first()
    assert (r["hit_at_1"], r["hit_at_5"]) == (pytest.approx(1 / 3), pytest.approx(2 / 3)) and (r["median_rank"], r["worst_rank"], r["mean_query_ms"]) == (4, 20, 4)


def test_agreement(spark):
    lists = spark.createDataFrame([("a", 1, ["x", "y", "z"]), ("b", 1, ["y", "x", "q"]), ("a", 2, ["x"]), ("b", 2, [])], "model string, query_id int, keys array<string>")
    r = E.model_agreement(lists, (1, 3)).first()
    assert (r["queries"], r["top1"], r["top3"]) == (2, 0.0, pytest.approx(1 / 3))
    row = lists.filter("query_id = 1").groupBy().agg(F.max_by("keys", "model").alias("b"), F.min_by("keys", "model").alias("a")).select(E.bounded_overlap_of(F.col("a"), F.col("b"), 2), E.recall_of(F.col("a"), F.col("b"), 1, 2)).first()
    assert tuple(row) == (1.0, 1.0)


def test_acceptance(spark):
    m = spark.createDataFrame([("mean", 0.99), ("minimum", 0.8)], "metric string, actual double")
    least = spark.createDataFrame([("mean", 0.98), ("minimum", 0.9), ("absent", 0.1)], "metric string, minimum double")
    assert {r["metric"] for r in E.acceptance(m, least).collect()} == {"minimum", "absent"}


CATALOG = "position long, key string, fingerprint long"


def test_reuse(spark):
    cached = spark.createDataFrame([(0, "same", 11, [1.0]), (1, "changed", 12, [2.0]), (2, "same", 11, [3.0]), (3, None, 1, [9.0])], CATALOG + ", embedding array<float>")
    catalog = spark.createDataFrame([(0, "same", 11), (1, "changed", 13), (2, "same", 11), (3, None, 1), (4, "x", None)], CATALOG)
    plan = B.plan_reuse(catalog, cached).orderBy("position").collect()
    assert [r["embedding"] for r in plan] == [[3.0], None, None, None, None]
    counts = B.plan_counts(B.plan_reuse(catalog, cached)).first()
    assert (counts["total"], counts["reused"], counts["missing"], counts["keys"]) == (5, 1, 4, 3)
    assert B.usable_cache({"model": "m@1", "dimensions": 1}, cached, "m@2", 1).count() == 0
    assert B.usable_cache({"model": "m@1", "dimensions": 1}, cached, "m@1", 1).count() == 4
    assert B.usable_cache(None, cached, "m@1", 1).count() == 0


def test_build(spark):
    cached = spark.createDataFrame([(0, "a", 1, [1.0, 0.0])], CATALOG + ", embedding array<float>")
    catalog = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "broken", 3)], CATALOG)

    def encode(missing):
        bad = F.col("key") == "broken"
        return missing.withColumn("embedding", F.when(~bad, F.array(F.lit(3.0), F.lit(4.0)).cast("array<float>"))).withColumn("error", F.when(bad, F.lit("no image")))

    index, skipped = B.build_index(catalog, cached, encode, 2)
    rows = {r["key"]: [round(x, 6) for x in r["embedding"]] for r in index.collect()}
    assert rows == {"a": [1.0, 0.0], "b": [0.6, 0.8]} and [r["key"] for r in skipped.collect()] == ["broken"]

    def never(missing):
        raise AssertionError("nothing is missing")

    assert B.build_index(catalog.filter("key = 'a'"), cached, never, 2)[0].count() == 1
    with pytest.raises(ValueError):
        B.build_index(catalog.limit(0), cached, never, 2)
    with pytest.raises(Exception, match="no direction"):
        B.build_index(catalog, cached, lambda m: m.withColumn("embedding", F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>")).withColumn("error", F.lit(None).cast("string")), 2)[0].collect()


def test_a_listing_reuses_the_one_before_it(spark, tmp_path):
    rows = [("a", 1, 0, "x", "1"), ("a", 1, 1, "y", "1"), ("a", 4, 0, "x", "1"), ("a", 4, 1, "x", "1"), ("a", 4, 2, "y", "2"), ("a", 7, 0, "y", "1"), ("a", 7, 1, "y", "2"), ("b", 2, 0, "x", "1"), ("b", 3, 0, "x", "1"), ("b", 3, 1, None, "1")]
    spark.createDataFrame(rows, "library string, snapshot_no long, position int, key string, fingerprint string").write.parquet(str(tmp_path / "index_snapshot.parquet"))
    found = catalogs.incremental_build_snapshots(spark, str(tmp_path)).select("library", "snapshot_no", "total", "reused", "missing", "keys")
    # the repeated x of a4 is encoded anew; a7 finds y/2 only, as y/1 is two listings back; b2 has no predecessor
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, 2, 0, 2, 2), ("a", 4, 3, 1, 2, 2), ("a", 7, 2, 1, 1, 1), ("b", 2, 1, 0, 1, 1), ("b", 3, 1, 1, 0, 1)]


@pytest.mark.parametrize("documents, anchors, others", [(50_000, 500, 0), (60_000, 600, 2400)])
def test_pool_of_many_documents(spark, tmp_path, documents, anchors, others):
    spark.range(1, documents + 1).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    found = dict(catalogs.pool(spark, str(tmp_path)).groupBy("is_anchor").count().collect())
    assert (found[True], found.get(False, 0)) == (anchors, others)


def test_pool(spark):
    items = spark.createDataFrame([(k,) for k in ("c", "anchor", "a", "b", None, "a")], "key string")
    anchors = items.filter("key = 'anchor'")
    one = sorted(tuple(r) for r in B.deterministic_pool(items, anchors, 3).collect())
    two = sorted(tuple(r) for r in B.deterministic_pool(items.orderBy(F.desc("key")), anchors, 3).collect())
    assert one == two and len(one) == 3 and ("anchor", True) in one
    with pytest.raises(ValueError):
        B.deterministic_pool(items, items.filter("key in ('a', 'b')"), 1)
    with pytest.raises(ValueError):
        B.deterministic_pool(items, spark.createDataFrame([("lost",)], "key string"), 3)


def test_presence_and_unshared(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "component string, v int")
    b = spark.createDataFrame([("y", 5), ("z", 6)], "component string, w int")
    assert {r["component"]: r["state"] for r in B.presence(a, b, "component").collect()} == {"x": "missing", "y": "active", "z": "inactive"}
    f = spark.createDataFrame([("a", "p"), ("b", "p"), ("a", "q"), ("a", "q"), ("b", None)], "owner string, path string")
    assert [tuple(r) for r in B.unshared(f, "owner", "path").collect()] == [("a", "q")]


def test_paired(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "ordinal int, l string")
    b = spark.createDataFrame([(0, "u"), (1, "v")], "ordinal int, r string")
    assert sorted(tuple(r) for r in E.paired(a, b).collect()) == [(0, "x", "u"), (1, "y", "v")]
    with pytest.raises(Exception, match="differ in length"):
        E.paired(a, b.filter("ordinal = 0")).collect()
