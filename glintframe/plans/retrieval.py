"""Search and evaluation queries over the embeddings table, and their SQL.

Queries are all rows whose id is divisible by 100, against all rows.  Models
for comparisons are the whole vectors and their halves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evaluate as E
from ..operators import search as S
from ..operators.relevance import relevant
from ..sources.tables import table
from .sqltext import COMPOSED, SCORED, dot

TOP = 8
EVERYTHING = 2**31 - 1


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("key", F.col("vec_id").cast("string"))


def _asked(items: DataFrame, k: int) -> DataFrame:
    return items.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit(k).alias("k"))


def _composed(items: DataFrame, k: int) -> DataFrame:
    """Queries whose negative is the next row's vector."""
    q = items.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("p"))
    n = items.select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("negative"))
    return q.join(n, "query_id").select("query_id", V.normalise(V.compose(F.col("p"), F.col("negative"), 0.5)).alias("vector"), "negative", F.lit(k).alias("k"))


def _out(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6))


def topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return _out(S.top_k(items, _asked(items, TOP)))


def maxpool_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    grouped = items.withColumn("key", F.col("label").cast("string"))
    return _out(S.top_k(grouped, _asked(items, TOP)))


def negation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return _out(S.top_k(items, _composed(items, 20)))


def exclusion_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    asked = _composed(items, EVERYTHING).select("query_id", F.col("negative").alias("vector"), "k")
    return S.thresholds(S.top_k(items, asked).select("query_id", "score")).withColumn("threshold", F.round("threshold", 6))


_SETTINGS = [
    ("window", 0.1, None, 0, None),
    ("prominence", None, 0.3, 3, 1),
    ("least and most", 0.02, 0.0, 4, 6),
    ("none", None, None, 0, None),
]


def relevance_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    names = (("setting", "string"), ("score_window", "double"), ("min_score_prominence", "double"), ("min_results", "int"), ("max_results", "int"))
    settings = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(n) for v, (n, kind) in zip(row, names, strict=True)]) for row in _SETTINGS])
    lists = S.top_k(items, _asked(items, 20)).select("*", F.inline(settings))
    return _out(relevant(lists, ["query_id", "setting"])).select("setting", "query_id", "rank", "key", "score")


def full_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return _out(S.top_k(items, _asked(items, EVERYTHING)))


def _judged(items: DataFrame, ranked: DataFrame) -> DataFrame:
    """Rankings with judgements: a query wants its own label, or the next even one, and forbids it where the item's id is odd."""
    labels = items.select("key", F.col("label").alias("item_label"), (F.col("vec_id") % 2 == 1).alias("odd"))
    own = items.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    required = F.col("item_label") == F.col("query_label")
    return (
        ranked.join(labels, "key").join(own.filter("query_id % 100 = 0"), "query_id")
        .withColumns({"required": required, "forbidden": F.col("odd"), "relevant": required & ~F.col("odd"), "kind": F.concat(F.lit("label "), (F.col("query_label") % 3).cast("string"))})
    )


def _totals(items: DataFrame, judged: DataFrame) -> DataFrame:
    positives = items.filter("vec_id % 2 = 0").groupBy("label").agg(F.count(F.lit(1)).alias("positives"))
    lengths = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"))
    q = items.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return q.join(positives, "label", "left").join(lengths, "query_id", "left").select("query_id", F.coalesce("positives", F.lit(0)).alias("positives"), F.coalesce("returned", F.lit(0)).alias("returned"))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all four variants: raw and composed queries, with and without the forbidden items."""
    items = _items(spark, sf_dir)
    plain = _composed(items, EVERYTHING).drop("negative")
    out = None
    for name, asked in (("raw", _asked(items, EVERYTHING)), ("composed", plain)):
        judged = _judged(items, S.top_k(items, asked))
        for variant, ranked in ((name, judged), (f"{name} filtered", E.rerank(judged, ~F.col("forbidden")))):
            m = E.retrieval_metrics(ranked, _totals(items, ranked), 10).withColumn("variant", F.lit(variant))
            out = m if out is None else out.unionByName(m)
    kinds = items.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("label "), (F.col("label") % 3).cast("string")).alias("kind"))
    return out.join(kinds, "query_id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({m: F.round(m, 6) for m in E.METRICS})


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_variants(spark, sf_dir)).select("variant", "query_id", "positive_count", *E.METRICS)


def metrics_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.mean_metrics(_variants(spark, sf_dir), "kind", ["variant"])).select("variant", "kind", "queries", *E.METRICS)


def _lists(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    items = _items(spark, sf_dir)
    out = None
    for model, vector in (("whole", F.col("embedding")), ("left", F.slice("embedding", 1, 32)), ("right", F.slice("embedding", 33, 32))):
        own = items.withColumn("embedding", vector)
        lists = S.top_k(own, _asked(own, k)).withColumn("model", F.lit(model))
        out = lists if out is None else out.unionByName(lists)
    return E.key_lists(out, k)


def model_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.model_agreement(_lists(spark, sf_dir, 10))
    return found.withColumns({f"top{k}": F.round(f"top{k}", 6) for k in (1, 3, 10)})


def retrieval_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.retrieval_fidelity(_lists(spark, sf_dir, 50), "whole", "left")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


def embedding_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector with itself less its last four elements."""
    v = table(spark, sf_dir, "embeddings").select("embedding", F.concat(F.slice("embedding", 1, 60), F.array_repeat(F.lit(0.0).cast("float"), 4)).alias("student"))
    cosine = v.select(V.dot(V.normalise(F.col("embedding"), "floor"), V.normalise(F.col("student"), "floor")).alias("cosine"))
    return cosine.agg(
        F.round(F.avg("cosine"), 6).alias("cosine_mean"), F.round(E.percentile_linear("cosine", 0.05), 6).alias("cosine_p05"), F.round(F.min("cosine"), 6).alias("cosine_minimum")
    )


def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_fidelity(spark, sf_dir)
    metrics = found.unpivot([], ["cosine_mean", "cosine_p05", "cosine_minimum"], "metric", "actual")
    minimums = spark.createDataFrame([("cosine_mean", 0.5), ("cosine_p05", 0.95), ("cosine_minimum", 0.99)], "metric string, minimum double")
    return E.acceptance(metrics, minimums)


def anchor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of each query's next row, with the row's number as time."""
    items = _items(spark, sf_dir)
    ranked = S.top_k(items, _asked(items, EVERYTHING))
    own = ranked.filter(F.col("key") == (F.col("query_id") + 1).cast("string")).withColumn("query_ms", F.col("query_id") / 8)
    found = E.anchor_summary(own)
    return found.select("queries", "worst_rank", *[F.round(c, 6).alias(c) for c in found.columns if c not in ("queries", "worst_rank")])


def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalising policies, projection, dequantised codes and the largest difference, for every row."""
    e = table(spark, sf_dir, "embeddings")
    x = F.col("embedding")
    two = [[1.0, -0.5]] * 32 + [[0.25, 2.0]] * 32
    codes = F.transform(x, lambda v: F.round((v + 1) * 100).cast("int"))
    zero = F.transform(x, lambda v: (v * 0).cast("float"))
    return e.select(
        "vec_id",
        F.round(V.norm(x), 6).alias("length"),
        F.round(V.dot(V.normalise(x), V.normalise(x)), 6).alias("unit"),
        V.normalise(zero).isNull().alias("zero_is_null"),
        F.round(V.norm(V.normalise(zero, "keep")), 6).alias("zero_kept"),
        F.round(V.norm(V.normalise(zero, "floor")), 6).alias("zero_floored"),
        F.round(V.project(x, two)[0], 6).alias("first"),
        F.round(V.project(x, two)[1], 6).alias("second"),
        F.round(F.aggregate(V.dequantise(codes, 0.5, 100), F.lit(0.0), lambda s, v: s + v), 6).alias("dequantised"),
        F.round(V.max_difference(x, F.reverse(x)), 6).alias("difference"),
    )


_RANK_COLS = "SELECT query_id, rank, key, round(score, 6) AS score FROM"
_NEGATED = f"""
WITH RECURSIVE {COMPOSED}, pair AS (
  SELECT u.query_id, e.vec_id::VARCHAR AS key, round({dot('u.v', 'e.embedding')}, 9) AS score, round({dot('u.negative', 'e.embedding')}, 9) AS bad FROM unit u, embeddings e
), sorted AS (
  SELECT query_id, list(bad ORDER BY bad) AS s FROM pair GROUP BY query_id
), means(query_id, s, i, lo, hi, done, ok) AS (
  SELECT query_id, s, 0, s[len(s) // 4 + 1], s[len(s) * 3 // 4 + 1], false, true FROM sorted WHERE len(s) >= 4 AND s[len(s) * 3 // 4 + 1] > s[len(s) // 4 + 1]
  UNION ALL
  SELECT query_id, s, i + 1, CASE WHEN a IS NULL OR b IS NULL THEN lo ELSE a END, CASE WHEN a IS NULL OR b IS NULL THEN hi ELSE b END,
         a IS NULL OR b IS NULL OR abs(a - lo) + abs(b - hi) < 1e-6, a IS NOT NULL AND b IS NOT NULL
  FROM (SELECT *, list_avg(list_filter(s, lambda x: x < (lo + hi) * 0.5)) AS a, list_avg(list_filter(s, lambda x: x >= (lo + hi) * 0.5)) AS b
        FROM means WHERE NOT done AND i < 16)
), threshold AS (
  SELECT s.query_id, m.t FROM sorted s LEFT JOIN (
    SELECT query_id, CASE WHEN ok THEN (lo + hi) * 0.5 END AS t FROM means QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i DESC) = 1) m USING (query_id)
)
"""
_LABEL_KIND = "'label ' || (t.query_label % 3)"
_VARIANTS = f"""
WITH {SCORED.strip()}, {COMPOSED.strip()}, cscored AS (
  SELECT u.query_id, u.query_label, e.vec_id::VARCHAR AS key, e.label, round({dot('u.v', 'e.embedding')}, 9) AS score FROM unit u, embeddings e
), every AS (
  SELECT 'raw' AS variant, query_id, query_label, key, label, score FROM scored
  UNION ALL SELECT 'composed', query_id, query_label, key, label, score FROM cscored
), variants AS (
  SELECT variant, query_id, query_label, key, label, score FROM every
  UNION ALL SELECT variant || ' filtered', query_id, query_label, key, label, score FROM every WHERE key::BIGINT % 2 = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY variant, query_id ORDER BY score DESC, key) AS rank, label = query_label AS required, key::BIGINT % 2 = 1 AS forbidden FROM variants
), first AS (
  SELECT *, (required AND NOT forbidden)::INT AS hit, sum((required AND NOT forbidden)::INT) OVER (PARTITION BY variant, query_id ORDER BY rank) AS found FROM placed WHERE rank <= 10
), total AS (
  SELECT p.variant, p.query_id, any_value(p.query_label) AS query_label, count(*) AS returned,
         any_value((SELECT count(*) FROM embeddings e WHERE e.label = p.query_label AND e.vec_id % 2 = 0)) AS positives
  FROM placed p GROUP BY p.variant, p.query_id
), metric AS (
  SELECT t.variant, t.query_id, {_LABEL_KIND} AS kind, t.positives AS positive_count,
    sum(hit) / 10 AS precision_at_k, CASE WHEN t.positives > 0 THEN sum(hit) / t.positives ELSE 0 END AS recall_at_k,
    coalesce(sum(CASE WHEN hit = 1 THEN found / rank END) / nullif(least(t.positives, 10), 0), 0) AS average_precision_at_k,
    coalesce(sum(CASE WHEN hit = 1 THEN 1 / log2(rank + 1) END) / nullif(list_sum(list_transform(range(1, least(t.positives, 10) + 1), lambda r: 1 / log2(r + 1))), 0), 0) AS ndcg_at_k,
    coalesce(1 / min(CASE WHEN hit = 1 THEN rank END), 0) AS reciprocal_rank, sum(required::INT) / 10 AS required_at_k, sum(forbidden::INT) / 10 AS forbidden_at_k
  FROM total t JOIN first f USING (variant, query_id) GROUP BY t.variant, t.query_id, t.query_label, t.positives, t.returned
)
"""
_M = ", ".join(f"round({m}, 6) AS {m}" for m in E.METRICS)
_MA = ", ".join(f"round(avg({m}), 6) AS {m}" for m in E.METRICS)


def _model_sql(k: int) -> str:
    part = lambda name, a, b: f"SELECT '{name}' AS model, vec_id, embedding[{a}:{b}] AS v FROM embeddings"
    return f"""
WITH model AS ({part('whole', 1, 64)} UNION ALL {part('left', 1, 32)} UNION ALL {part('right', 33, 64)}), placed AS (
  SELECT q.model, q.vec_id AS query_id, e.vec_id::VARCHAR AS key,
         row_number() OVER (PARTITION BY q.model, q.vec_id ORDER BY round({dot('q.v', 'e.v')}, 9) DESC, e.vec_id::VARCHAR) AS rank
  FROM model q JOIN model e USING (model) WHERE q.vec_id % 100 = 0
), lists AS (SELECT model, query_id, list(key ORDER BY rank) AS keys FROM placed WHERE rank <= {k} GROUP BY model, query_id)
"""


_SETTING_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in _SETTINGS)
_INTER = lambda a, b, k, m: f"len(list_intersect({a}[1:{k}], {b}[1:{m}]))"
_FIDELITY = """
WITH c AS (SELECT list_sum(list_transform(embedding[1:60], lambda x: x::DOUBLE * x::DOUBLE)) AS s, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS w FROM embeddings),
f AS (SELECT round(avg(s / (sqrt(s) * sqrt(w))), 6) AS cosine_mean, round(quantile_cont(s / (sqrt(s) * sqrt(w)), 0.05), 6) AS cosine_p05, round(min(s / (sqrt(s) * sqrt(w))), 6) AS cosine_minimum FROM c)
"""

QUERIES = {
    f.__name__: f
    for f in (
        topk_search, maxpool_search, negation_search, exclusion_thresholds, relevance_cut, full_ranking, retrieval_metrics, metrics_by_kind,
        model_agreement, retrieval_fidelity, embedding_fidelity, acceptance, anchor_summary, vector_functions,
    )
}
SQL = {
    "topk_search": f"WITH {SCORED} {_RANK_COLS} ranked WHERE rank <= {TOP}",
    "maxpool_search": f"""WITH {SCORED}, pooled AS (SELECT query_id, label::VARCHAR AS key, max(score) AS score FROM scored GROUP BY ALL),
        placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::INTEGER AS rank FROM pooled) {_RANK_COLS} placed WHERE rank <= {TOP}""",
    "negation_search": f"""{_NEGATED}, kept AS (SELECT p.*, row_number() OVER (PARTITION BY p.query_id ORDER BY score DESC, key)::INTEGER AS rank
        FROM pair p JOIN threshold t USING (query_id) WHERE t.t IS NULL OR bad < t.t) {_RANK_COLS} kept WHERE rank <= 20""",
    "exclusion_thresholds": f"{_NEGATED} SELECT query_id, round(t, 6) AS threshold FROM threshold",
    "relevance_cut": f"""WITH {SCORED}, setting(setting, win, prom, least, most) AS (VALUES {_SETTING_ROWS}), top AS (SELECT * FROM ranked, setting WHERE rank <= 20),
        stat AS (SELECT *, count(*) OVER w AS n, max(score) OVER w AS best, count(*) FILTER (WHERE win IS NULL OR score >= best_ - win) OVER w AS inside,
                 max(CASE WHEN rank = n_ // 2 + 1 THEN score END) OVER w AS middle
                 FROM (SELECT *, max(score) OVER w AS best_, count(*) OVER w AS n_ FROM top WINDOW w AS (PARTITION BY query_id, setting)) WINDOW w AS (PARTITION BY query_id, setting))
        SELECT setting, query_id, rank, key, round(score, 6) AS score FROM stat
        WHERE rank <= CASE WHEN prom IS NULL OR n < 4 OR best - middle >= prom THEN least(greatest(inside, least(least, n)), least(coalesce(most, n), n)) ELSE least(least, n) END""",
    "full_ranking": f"WITH {SCORED} {_RANK_COLS} ranked",
    "retrieval_metrics": f"{_VARIANTS} SELECT variant, query_id, positive_count, {_M} FROM metric",
    "metrics_by_kind": f"{_VARIANTS} SELECT variant, kind, count(*) AS queries, {_MA} FROM metric WHERE positive_count > 0 GROUP BY GROUPING SETS ((variant, kind), (variant))",
    "model_agreement": f"""{_model_sql(10)} SELECT a.model AS left_model, b.model AS right_model, count(*) AS queries,
        {', '.join(f"round(avg({_INTER('a.keys', 'b.keys', k, k)} / {k}), 6) AS top{k}" for k in (1, 3, 10))}
        FROM lists a JOIN lists b ON a.query_id = b.query_id AND a.model < b.model GROUP BY a.model, b.model""",
    "retrieval_fidelity": f"""{_model_sql(50)} SELECT round(avg((t.keys[1] = s.keys[1])::INT), 6) AS top1_agreement,
        {', '.join(f"round(avg({_INTER('t.keys', 's.keys', k, m)} / {k}), 6) AS {n}" for k, m, n in ((3, 3, 'top3_overlap'), (3, 5, 'teacher_top3_recall_at_5'), (10, 10, 'top10_overlap'), (10, 50, 'teacher_top10_recall_at_50')))}
        FROM lists t JOIN lists s USING (query_id) WHERE t.model = 'whole' AND s.model = 'left'""",
    "embedding_fidelity": f"{_FIDELITY} SELECT * FROM f",
    "acceptance": f"""{_FIDELITY}, m(metric, minimum) AS (VALUES ('cosine_mean', 0.5::DOUBLE), ('cosine_p05', 0.95), ('cosine_minimum', 0.99))
        SELECT metric, actual, minimum FROM (UNPIVOT f ON cosine_mean, cosine_p05, cosine_minimum INTO NAME metric VALUE actual) JOIN m USING (metric) WHERE actual < minimum""",
    "anchor_summary": f"""WITH {SCORED}, own AS (SELECT rank, query_id / 8 AS ms FROM ranked WHERE key = (query_id + 1)::VARCHAR)
        SELECT count(*) AS queries, max(rank) AS worst_rank, {', '.join(f"round(avg((rank <= {k})::INT), 6) AS hit_at_{k}" for k in (1, 5, 10))},
        round(avg(1 / rank), 6) AS mean_reciprocal_rank, round(median(rank), 6) AS median_rank, round(avg(ms), 6) AS mean_query_ms FROM own""",
    "vector_functions": """
        SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length, 1.0::DOUBLE AS unit, true AS zero_is_null, 0.0::DOUBLE AS zero_kept, 0.0::DOUBLE AS zero_floored,
          round(list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE)) + 0.25 * list_sum(list_transform(embedding[33:64], lambda x: x::DOUBLE)), 6) AS first,
          round(-0.5 * list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE)) + 2 * list_sum(list_transform(embedding[33:64], lambda x: x::DOUBLE)), 6) AS second,
          round(list_sum(list_transform(embedding, lambda x: 0.5 * (round((x + 1::FLOAT) * 100) - 100))), 6) AS dequantised,
          round(list_max(list_transform(list_zip(embedding, list_reverse(embedding)), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))), 6) AS difference
        FROM embeddings""",
}
