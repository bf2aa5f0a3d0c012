"""Top N of groups, collapsing of formats, mixtures."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.llm import formatting, mixing, topn

MATCH = "match_id long, generation decimal(20,0), key string, score float, rank int, bucket int, g long, n int"
REQUEST = "generation decimal(20,0), top_k long"


def tops(spark, matches, requests, **kw):
    m = spark.createDataFrame([(i, None if g is None else Decimal(g), k, s, r, 1, 2, 3) for i, g, k, s, r in matches], MATCH)
    q = spark.createDataFrame([(None if g is None else Decimal(g), n) for g, n in requests], REQUEST)
    out = topn.top_n_per_group(m.repartition(3), q, "generation", "key", "score", "rank", "match_id", "top_k")
    return sorted(r[0] for r in out.collect())


def brute(matches, requests):
    n = {}
    for g, k in requests:
        if g is not None and k and k > 0:
            n[g] = max(n.get(g, 0), k)
    out = []
    for g, most in n.items():
        rows = [m for m in matches if m[1] == g and m[2] is not None and m[3] is not None and m[3] == m[3]]
        rows.sort(key=lambda m: (-np.float32(m[3]), m[4] is None, m[4] or 0, m[0]))
        seen = set()
        for m in rows:
            if m[2] not in seen and len(seen) < most:
                seen.add(m[2])
                out.append(m[0])
    return sorted(out)


def test_top_n_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(topn, "RUN_ROWS", 1 << 30)
    rng = random.Random(8)
    big = 2**64 - 1
    matches = [
        (i, rng.choice([0, 1, 2, 3, big, 7, None, 5, 5, 5, 5]), rng.choice(["", None, *(f"k{j}" for j in range(30))]), rng.choice([0.0, -0.0, 0.5, 0.25, float("nan"), None, rng.random()]), rng.choice([None, 1, 2, 3]))
        for i in range(3000)
    ]
    requests = [(0, 3), (1, 5), (2, 0), (3, None), (big, 2), (5, 11), (5, 11), (9, 4), (None, 3)]
    assert tops(spark, matches, requests) == brute(matches, requests)


@pytest.mark.parametrize("wave", [10, 4_000_000])
def test_many_runs_of_a_hot_group(spark, monkeypatch, wave):
    rng = random.Random(9)
    rows = [(i, 1 if i % 3 else rng.randrange(40), f"k{rng.randrange(300)}", rng.randrange(8) / 8, rng.choice([None, 1])) for i in range(4000)]
    limits = {g: 17 for g in range(40)}
    runs, tables = [], [rows[i : i + 250] for i in range(0, len(rows), 250)]
    import pyarrow as pa

    for part in tables:
        cols = list(zip(*part, strict=True))
        t = pa.table({"g": np.array(cols[1], np.int64), "score": np.array(cols[3], np.float32), "rank": np.array([2**63 - 1 if r is None else r for r in cols[4]], np.int64), "id": np.array(cols[0], np.int64), "item": list(cols[2])})
        runs.append(topn.build_run(t, topn.Bound(17, np.zeros(0, np.int64), np.zeros(0, np.int64))))
    monkeypatch.setattr(topn, "WAVE_ROWS", wave)
    blocks = [(0, 0, np.array([list(limits), list(limits.values())], np.int64).tobytes())] + [(0, 1, r.pack()) for r in runs]
    got = [i for b in topn._merger(iter([topn._packed(blocks)])) for i in b["id"].to_pylist()]
    assert sorted(got) == brute(rows, list(limits.items()))


def test_top_n_of_nothing(spark):
    assert tops(spark, [], [(1, 3)]) == []
    assert tops(spark, [(1, 1, "k", 0.5, 1)], []) == []


@pytest.mark.parametrize("large", [0, 1, 3, 100])
def test_one_very_large_n(spark, monkeypatch, large):
    """The N of a few groups doesn't hold for the runs of all others."""
    monkeypatch.setattr(topn, "LARGE_GROUPS", large)
    rng = random.Random(large)
    matches = [(i, rng.choice([1, 1, 1, 2, 3, 4, 5]), f"k{rng.randrange(60)}", rng.choice([0.1, 0.2, 0.3]), rng.choice([None, 1, 2])) for i in range(900)]
    requests = [(1, 40), (2, 3), (3, 2), (4, 1)]
    assert tops(spark, matches, requests) == brute(matches, requests)
    bound = topn.bound_of(spark.createDataFrame(requests, "g long, n long"))
    assert bound.of(np.array([1, 2, 3, 4])).tolist() == {0: [64] * 4, 1: [40, 4, 4, 4], 3: [40, 3, 2, 1], 100: [40, 3, 2, 1]}[large]
    assert bound.of(np.array([9])).tolist() == [{0: 64, 1: 4, 3: 1, 100: 0}[large]]


def canon(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", formatting.canonical(F.col("t")).alias("c")).orderBy("i").select("c").collect()]


def test_canonical_forms(spark):
    same = [["Red  Fox!", "red fox", "RED-FOX", "redfox"], ["a=1; b: Two", "B=two|A=1", "b:TWO\na:1,", " ;a = 1 & b=two"]]
    for group in same:
        assert len(set(canon(spark, group))) == 1
    different = canon(spark, ["red fox", "fox red", "redfox=", "réd fox", "a=1;b=2", "a=2;b=1", "a=1;a=1", "a=1", "12", "a:b=c", "ab:c"])
    assert len(set(different)) == len(different)
    assert canon(spark, [None, "", " ", "?!;:", "👍"]) == [None] * 5
    # a final sigma depends on what follows in the text, not on the letters
    assert len(set(canon(spark, ["ΟΔΟΣ ΑΒ", "οδοσ-αβ", "οδος αβ", "ΟΔΟΣΑΒ"]))) == 1


def test_common_texts_are_spread(spark, monkeypatch):
    rows = [(i, "Red fox" if i % 3 else "red  fox") for i in range(1, 400)] + [(500 + i, f"only {i}") for i in range(20)] + [(600, "only 3!")]
    df = spark.createDataFrame(rows, "request_id long, query string")
    whole = sorted(map(tuple, formatting.copies(df, "query", "request_id").collect()))
    monkeypatch.setattr(formatting, "TEXT_ROWS", 50)
    assert sorted(map(tuple, formatting.copies(df, "query", "request_id").collect())) == whole == [(1, i) for i in range(2, 400)] + [(503, 600)]


def test_collapse(spark):
    rows = [(5, "Red fox"), (3, "red  fox"), (9, "red  fox"), (4, None), (1, "!!"), (2, "x=1;y=2"), (8, "Y=2,X=1"), (None, "red fox")]
    df = spark.createDataFrame(rows, "request_id long, query string").withColumns({"first": F.lit(1), "canonical": F.lit("z"), "_n": F.lit(2)})
    classes, _ = formatting.collapse(df, "query", "request_id")
    assert sorted((r["first"], r["copies"]) for r in classes.collect()) == [(2, 2), (3, 3)]
    assert sorted(tuple(r) for r in formatting.copies(df, "query", "request_id").collect()) == [(2, 8), (3, 5), (3, 9)]
    assert formatting.copies(df.limit(0), "query", "request_id").count() == 0
    long = spark.createDataFrame([(1, "ab " * 100_000), (2, "AB" * 100_000)], "request_id long, query string")
    assert [tuple(r) for r in formatting.copies(long, "query", "request_id").collect()] == [(1, 2)]


def test_apportion():
    assert mixing.apportion({"a": 53, "b": 24, "c": 23}, dict.fromkeys("abc", 99), 7) == {"a": 3, "b": 2, "c": 2}
    assert mixing.apportion({"a": 0.5, "b": 0.5}, {"a": 2, "b": 99}, 10) == {"a": 2, "b": 8}
    assert mixing.apportion({"a": 1.0, "b": 0.0}, {"a": 3, "b": 5}, 10) == {"a": 3, "b": 0}
    assert mixing.apportion({}, {}, 3) == {}
    assert mixing.apportion({"b": 1, "a": 1, "c": 1}, dict.fromkeys("abc", 9), 4) == {"a": 2, "b": 1, "c": 1}
    rng = random.Random(4)
    for _ in range(60):
        keys = [f"k{i}" for i in range(rng.randrange(1, 9))]
        w = {k: rng.choice([rng.random(), 1, 2, 0.5, 0]) for k in keys}
        caps = {k: rng.choice([0, 1, 3, 50]) for k in keys}
        seats = rng.randrange(0, 90)
        quotients = sorted((-w[k] / (2 * n + 1), k) for k in keys if w[k] > 0 for n in range(caps[k]))[:seats]
        assert mixing.apportion(w, caps, seats) == {k: sum(q[1] == k for q in quotients) for k in keys}


@pytest.mark.parametrize("shards", [1, 50, 5_000, 50_000])
def test_shares_at_any_number_of_shards(shards):
    """A small source repeated up to four times and a share that none misses; shards of uneven size."""
    rng = np.random.default_rng(shards)
    part = {"big": 0.9, "small": 0.02, "tiny": 0.01, "rest": 0.07}
    sums = {s: dict(enumerate(np.maximum(1, rng.normal(6e6 * x, 2e5 * x, shards)).astype(np.int64).tolist())) for s, x in part.items()}
    aims = {"big": (0.6, 1), "small": (0.05, 4), "tiny": (0.02, 2), "rest": (0.33, 9)}
    total = sum(sum(v.values()) for v in sums.values())
    got = mixing.quotas(sums, aims, total)
    for s, (share, repeats) in aims.items():
        mine = [(q, sums[s][k]) for t, k, q in got if t == s]
        assert all(0 < q <= repeats * n for q, n in mine)
        reached = min(share * total, repeats * sum(sums[s].values()))
        assert sum(q for q, _ in mine) == pytest.approx(reached, rel=1e-3), s


def test_tiny_quotas_of_many_shards(spark, monkeypatch):
    """Of every shard less than a document is wanted."""
    monkeypatch.setattr(mixing, "SHARD_ROWS", 10)
    df = spark.range(4000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'a', 'b') AS source", "repeat('word ', 50) AS text")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    _, report = mixing.mixture(df, targets, total_tokens=8000)
    assert {r["source"]: r["tokens"] for r in report.collect()} == pytest.approx({"a": 4000, "b": 4000}, rel=0.1)


def test_mixture(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["big", "big", "big", "small"]), "word " * rng.randrange(1, 40)) for i in range(2000)]
    docs += [(5000, None, "x"), (5001, "other", "x y"), (5002, "big", None), (5003, "small", ""), (5004, "tiny", "one two three")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({"tokens": F.lit(1), "shard": F.lit(2), "copies": F.lit(3)})
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.5, 4), ("tiny", 0.05, 2), ("absent", 0.05, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mixture(df, targets)
    shares = {r["source"]: r for r in report.collect()}
    assert shares["absent"]["actual_share"] == 0 and shares["tiny"]["max_copies"] == 2
    assert shares["small"]["actual_share"] / shares["big"]["actual_share"] == pytest.approx(1.25, rel=0.02)
    assert all(r["max_copies"] <= m for r, m in ((shares["big"], 1), (shares["small"], 4)))
    assert {r["source"] for r in mixed.collect()} == {"big", "small", "tiny"}
    again, _ = mixing.mixture(df.repartition(7), targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))
    part, report = mixing.mixture(df, targets, total_tokens=3000)
    assert {r["source"]: r["actual_share"] for r in report.collect() if r["source"] in ("big", "small")} == pytest.approx({"big": 0.4 / 0.9, "small": 0.5 / 0.9}, rel=0.05)
    none, report = mixing.mixture(df.limit(0), targets)
    assert none.count() == 0 and {r["actual_share"] for r in report.collect()} == {0.0}
