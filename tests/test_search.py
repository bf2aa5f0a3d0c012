"""Golden values of the search and the cuts, and odd inputs."""

import math
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.functions import vectors as V
from glintframe.operators import search as S
from glintframe.operators.durable import ensure_checkpoint_dir
from glintframe.operators.relevance import relevant

INDEX = "position long, key string, embedding array<float>"


def index(spark, rows):
    return spark.createDataFrame([(i, k, None if v is None else [None if x is None else float(x) for x in v]) for i, (k, v) in enumerate(rows)], INDEX)


def ask(spark, vector, k, negative=None):
    return spark.createDataFrame([(1, [float(x) for x in vector], k, negative)], "query_id long, vector array<double>, k long, negative array<double>")


def found(df):
    return [(r["key"], round(r["score"], 6)) for r in df.orderBy("query_id", "rank").collect()]


def test_groups_score_by_their_best_row(spark):
    df = index(spark, [("video", (0.1, 0)), ("video", (0.9, 0)), ("still", (0.8, 0))])
    assert found(S.top_k(df, ask(spark, (1, 0), 3))) == [("video", 0.9), ("still", 0.8)]


def test_two_groups_have_no_threshold(spark):
    df = index(spark, [("forest", (0.9, 0.1)), ("abstract", (0.2, 0.8))])
    assert found(S.top_k(df, ask(spark, (1, 0), 10, [0.0, 1.0]))) == [("forest", 0.9), ("abstract", 0.2)]


SIX = [("item-0", (0.9, 0.02)), ("item-1", (0.8, 0.04)), ("item-2", (0.7, 0.06)), ("item-3", (0.6, 0.82)), ("item-4", (0.5, 0.88)), ("item-5", (0.4, 0.94))]


def test_negative_drops_the_upper_cluster(spark):
    assert [k for k, _ in found(S.top_k(index(spark, SIX), ask(spark, (1, 0), 10, [0.0, 1.0])))] == ["item-0", "item-1", "item-2"]


@pytest.mark.parametrize("limit", [2_000_000, 3])
def test_threshold_by_sorting_and_by_aggregates(spark, limit):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 0.1, 300), rng.normal(0.7, 0.1, 200)])
    df = spark.createDataFrame([(q, float(v)) for q in (1, 2) for v in values * q] + [(3, 0.5)] * 5 + [(4, 0.1), (4, 0.9), (4, float("nan"))], "query_id long, score double")
    got = {r[0]: r[1] for r in S.thresholds(df, limit).collect()}

    def loop(values):
        s = np.sort(values)
        lo, hi = s[len(s) // 4], s[3 * len(s) // 4]
        for _ in range(16):
            m = (lo + hi) / 2
            a, b = s[s < m].mean(), s[s >= m].mean()
            done = abs(a - lo) + abs(b - hi) < 1e-6
            lo, hi = a, b
            if done:
                break
        return (lo + hi) / 2

    lists = df.groupBy("query_id").agg(S.exclusion_threshold(F.collect_list("score")).alias("t"))
    assert {r[0]: r[1] for r in lists.collect() if r[1] is not None} == pytest.approx({q: t for q, t in got.items() if t is not None}, abs=1e-9)
    assert got[1] == pytest.approx(loop(values), abs=1e-9)
    assert got[2] == pytest.approx(loop(values * 2), abs=1e-9)
    assert got.get(3) is None and got.get(4) is None


def test_odd_rows_and_queries(spark):
    nan = float("nan")
    df = index(spark, [("a", (1, 0)), ("b", (1, 0)), (None, (9, 9)), ("n", (nan, 0)), ("short", (1,)), ("null", None), ("hole", (None, 1)), ("a", (0.5, 0))])
    assert found(S.top_k(df, ask(spark, (1, 0), 2))) == [("a", 1.0), ("b", 1.0)]
    tail = found(S.top_k(df, ask(spark, (1, 0), 9)))[2:]
    assert [k for k, _ in tail] == ["hole", "n"] and all(s == -math.inf for _, s in tail)
    q = spark.createDataFrame([(None, [1.0, 0.0], 3), (2, None, 3), (3, [1.0, 0.0], 0), (4, [1.0, 0.0], None), (5, [None, 1.0], 2)], "query_id long, vector array<double>, k long")
    assert S.top_k(df, q).count() == 0
    assert S.top_k(df.limit(0), ask(spark, (1, 0), 2)).count() == 0


def test_clashing_columns(spark):
    df = index(spark, SIX).withColumns({"score": F.lit("x"), "query_id": F.lit(7), "rank": F.lit(0)})
    assert len(found(S.top_k(df, ask(spark, (1, 0), 4)))) == 4


def cut(spark, scores, window=None, prominence=None, least=0, most=None):
    rows = [(1, i + 1, s, window, prominence, least, most) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "query_id long, rank int, score double, score_window double, min_score_prominence double, min_results int, max_results int")
    return relevant(df, ["query_id"]).count()


def test_relevance(spark):
    s = [0.150, 0.140, 0.130, 0.080]
    assert cut(spark, s, 0.025, None, 0, 256) == 3
    assert cut(spark, s, 0.005, None, 2, 256) == 2
    assert cut(spark, s, 1.0, None, 0, 2) == 2
    assert cut(spark, s) == 4
    flat = [0.063, 0.061, 0.060, 0.059]
    assert cut(spark, flat, 0.022, 0.015) == 0
    assert cut(spark, flat, 0.022, 0.0) == 4
    assert cut(spark, flat, 0.022, 0.015, 1) == 1
    assert cut(spark, flat[:2], 0.022, 0.015) == 2
    assert cut(spark, flat, 0.022, 0.015, 3, 1) == 3


def test_vector_functions(spark):
    row = spark.range(1).select(
        V.normalise(F.array(F.lit(3.0), F.lit(4.0))).alias("unit"),
        V.normalise(F.array(F.lit(0.0), F.lit(0.0))).alias("zero"),
        V.dequantise(F.array(*map(F.lit, (9, 14, 10, 12))), 0.5, 10).alias("codes"),
        V.project(F.array(F.lit(2.0), F.lit(3.0)), [[1, 2, 3], [4, 5, 6]]).alias("mapped"),
        V.project(F.array(F.lit(2.0)), [[1, 2, 3], [4, 5, 6]]).alias("odd"),
        V.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("widths"),
        V.compose(F.array(F.lit(1.0)), F.lit(None).cast("array<double>"), 0.5).alias("alone"),
    ).first()
    assert row["unit"] == pytest.approx([0.6, 0.8]) and row["zero"] is None
    assert row["codes"] == [-0.5, 2.0, 0.0, 1.0] and row["mapped"] == [14.0, 19.0, 24.0]
    assert row["odd"] is None and row["widths"] is None and row["alone"] == [1.0]


def test_float_mode_is_a_single_precision_loop(spark):
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 64)).astype(np.float32)
    total = np.float32(0)
    for x, y in zip(a, b, strict=True):
        total = np.float32(total + np.float32(x * y))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<float>, b array<float>")
    assert np.float32(df.select(V.dot(F.col("a"), F.col("b"), "float")).first()[0]) == total


def test_many_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BLOCK", 3)
    monkeypatch.setattr(S, "OPEN_BLOCKS", 2)
    rng = np.random.default_rng(5)
    items = rng.standard_normal((40, 4))
    df = index(spark, [(f"k{i:02d}", v) for i, v in enumerate(items)])
    asked = rng.standard_normal((17, 4))
    q = spark.createDataFrame([(i, v.tolist(), 2 + i % 3) for i, v in enumerate(asked)] + [(90, [1.0], 2)], "query_id long, vector array<double>, k long")
    got = {}
    for r in S.top_k(df.repartition(3), q).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["key"]))
    scores = asked @ np.float32(items).T
    want = {i: [(n + 1, f"k{j:02d}") for n, j in enumerate(np.argsort(-s)[: 2 + i % 3])] for i, s in enumerate(scores)}
    assert {i: sorted(v) for i, v in got.items()} == want


def test_both_ways_to_thresholds(spark):
    """Thresholds found in one row a query, and by aggregates over all groups."""
    rng = np.random.default_rng(12)
    rows = [(1, float(x)) for x in np.r_[rng.normal(0.1, 0.02, 60), rng.normal(0.7, 0.05, 25)]] + [(2, 0.5)] * 9 + [(3, 0.1), (3, 0.2), (3, 0.9)] + [(4, float(x)) for x in rng.random(41)] + [(4, float("nan")), (4, None)]
    scores = spark.createDataFrame(rows, "query_id long, score double")
    one, many = ({r["query_id"]: r["threshold"] for r in S.thresholds(scores, n).collect() if r["threshold"] is not None} for n in (2_000_000, 0))
    assert one.keys() == many.keys() == {1, 4}
    assert all(abs(one[q] - many[q]) < 1e-12 for q in one)


def brute(rows, asked, threshold):
    """(query_id, rank, key, score) by one matrix of scores."""
    keys = sorted({k for k, _ in rows})
    m = np.array([v for _, v in rows], np.float32).astype(np.float64)
    at = np.array([keys.index(k) for k, _ in rows])

    def best(v):
        out = np.full(len(keys), -np.inf)
        np.maximum.at(out, at, m @ np.array(v))
        return np.round(out, 9)

    out = []
    for i, v, k, negative in asked:
        s = best(v)
        t = None if negative is None else threshold(best(negative))
        kept = [j for j in range(len(keys)) if t is None or best(negative)[j] < t]
        out += [(i, n + 1, keys[j], s[j]) for n, j in enumerate(sorted(kept, key=lambda j: (-s[j], keys[j]))[:k])]
    return out


@pytest.mark.parametrize("sampled, groups", [(10_000, 2_000_000), (1, 2_000_000), (10_000, 5)])
def test_groups_of_many_rows_and_shared_negatives(spark, monkeypatch, sampled, groups):
    """Groups longer than what is scored at once, spread over partitions, with and without negative vectors in one block."""
    monkeypatch.setattr(S, "SAMPLED_QUERIES", sampled)
    rng = np.random.default_rng(21)
    rows = [(f"k{min(rng.integers(0, 60, 3)):02d}", np.round(rng.standard_normal(6), 2).tolist()) for _ in range(1500)]
    negatives = [None, *np.round(rng.standard_normal((3, 6)), 1).tolist()]
    asked = [(i, np.round(rng.standard_normal(6), 2).tolist(), int(rng.choice([1, 4, 30, 99])), negatives[i % 4]) for i in range(24)]
    q = spark.createDataFrame(asked, "query_id long, vector array<double>, k long, negative array<double>")
    got = sorted(tuple(r) for r in S.top_k(index(spark, rows).repartition(5), q, threshold_groups=groups).collect())
    want = brute(rows, asked, S.two_means)
    assert [r[:3] for r in got] == [r[:3] for r in want] and len(got) > 100
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=0, atol=2e-9)


def test_negated_queries_write_no_score_of_every_group(spark):
    """What is written for many queries with a few negative vectors grows with the index, not with queries times groups."""
    rng = np.random.default_rng(22)
    df = index(spark, [(f"k{i}", v) for i, v in enumerate(rng.standard_normal((2000, 8)))])
    negatives = rng.standard_normal((2, 8)).tolist()
    q = spark.createDataFrame([(i, v.tolist(), 3, negatives[i % 2]) for i, v in enumerate(rng.standard_normal((300, 8)))], "query_id long, vector array<double>, k long, negative array<double>")
    ensure_checkpoint_dir(spark)
    folder = Path(urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path)

    def written():
        return sum(p.stat().st_size for p in folder.rglob("part-*"))

    before = written()
    assert S.top_k(df, q).count() == 900
    # 0.12 MB measured; one row for each of 300 queries and 2,000 groups took 13.7 MB
    assert written() - before < 2_000_000
