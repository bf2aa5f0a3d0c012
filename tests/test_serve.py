"""Answering requests in batches and streams; ridge fits; JSON documents."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.functions.encoders import hashing_factory
from glintframe.operators import distill, requests
from glintframe.sources import documents as D
from glintframe.sources import index_file as X
from glintframe.streaming import command
from glintframe.streaming import serve as S

DIM = 16


@pytest.fixture(scope="module")
def index(spark):
    encode = hashing_factory(DIM)()
    rows = [(i, w, [float(x) for x in encode(w) / np.linalg.norm(encode(w))]) for i, w in enumerate("red green blue fox boat kite tower".split())]
    return spark.createDataFrame(rows, "position long, key string, embedding array<float>")


LINES = [
    '{"generation": 18446744073709551615, "query": "red fox", "topK": 3}',
    '{"generation": 2, "query": "  ", "topK": 3}',
    '{"generation": 3, "query": "red", "topK": 0}',
    "not json",
    "",
    '{"generation": 4, "query": "boat", "embeddingOnly": true, "topK": 0}',
    '{"generation": 5, "query": "red fox", "negativeQuery": "fox", "topK": 7, "minResults": 1}',
    '{"generation": 6, "query": "fox", "negativeQuery": "fox", "negativeWeight": 1.0, "topK": 2}',
    '{"generation": 7, "query": "kite", "topK": 5, "scoreWindow": 0.0}',
    '{"query": "no generation", "topK": 5}',
]


def check(lines):
    got = [json.loads(x) for x in lines]
    by = {}
    for r in got:
        by.setdefault(r["generation"], []).append(r)
    assert len(got) == 9 and len(by[0]) == 2 and all(r["error"] for r in by[0])
    assert {m["key"] for m in by[2**64 - 1][0]["matches"]} >= {"red", "fox"} and by[2**64 - 1][0]["error"] is None
    assert by[2][0]["error"] == "query must not be empty" and by[3][0]["error"] == "top-k must be positive"
    assert len(by[4][0]["embedding"]) == DIM and by[4][0]["matches"] == [] and "embedding" not in by[5][0]
    assert "fox" not in {m["key"] for m in by[5][0]["matches"]}
    assert by[6][0]["error"] == "the query vector has no direction"
    assert [m["key"] for m in by[7][0]["matches"]] == ["kite"] and by[7][0]["matches"][0]["rank"] == 1


def test_batch(spark, index):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    check([r["value"] for r in S.responses(D.parse_requests(lines), index, hashing_factory(DIM)).collect()])
    empty = D.parse_requests(lines.limit(0))
    assert S.responses(empty, index, hashing_factory(DIM)).count() == 0


def test_timings(spark, index):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    by = {r["generation"]: r for r in S.answer(D.parse_requests(lines), index, hashing_factory(DIM), timings=True).collect()}
    assert by[5]["query_ms"] > 0 and by[5]["search_ms"] > 0
    assert by[4]["query_ms"] > 0 and by[4]["search_ms"] is None and by[2]["query_ms"] is None


def test_report_and_command(spark, index, tmp_path, capsys):
    path = tmp_path / "i.sidx"
    X.export_index(index.withColumn("fingerprint", F.lit(1)), path, "hashing@1", 7, DIM)
    assert command.main([str(path), "red fox", "--top-k", "3", "--min-results", "2"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert (out["format"], out["model"], out["indexModel"], out["items"], out["embeddings"], out["dimensions"], out["threads"]) == (1, "hashing", "hashing@1", 7, 7, DIM, 1)
    assert {m["key"] for m in out["matches"]} >= {"red", "fox"} and len(out["matches"]) == 3 and out["queryMs"] > 0 and out["searchMs"] > 0
    assert command.main([str(path), " "], spark) == 1
    assert json.loads(capsys.readouterr().out)["message"] == "query must not be empty"
    assert command.main([str(tmp_path / "none.sidx"), "x"], spark) == 1
    for wrong in (["--top-k", "3", "--top-k", "4"], ["--top"], ["--negative-weight", "x"]):
        with pytest.raises(SystemExit):
            command.main([str(path), "x", *wrong], spark)


def test_stream(spark, index, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.jsonl").write_text("\n".join(LINES))
    q = S.serve(D.read_request_stream(spark, str(tmp_path / "in")), index, hashing_factory(DIM), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None
    check([r["value"] for r in spark.read.text(str(tmp_path / "out" / "batch=*")).collect()])


def test_maintained_index(spark, tmp_path):
    schema = "position long, key string, fingerprint long, embedding array<float>"
    (tmp_path / "in").mkdir()
    for n, rows in enumerate([[(0, "a", 1), (1, "b", 2), (2, "a", 3)], [(0, "b", 9), (1, "c", 4)]]):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"position": p, "key": k, "fingerprint": f, "embedding": [1.0]}) for p, k, f in rows))
        (tmp_path / "t").mkdir(exist_ok=True)
        S.maintain(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination(120)
    now = (tmp_path / "t" / "_current").read_text()
    assert {r["key"]: r["fingerprint"] for r in spark.read.parquet(str(tmp_path / "t" / now)).collect()} == {"a": 3, "b": 9, "c": 4}


def test_latest_generation(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), (None, 2)], "client string, generation int")
    assert {r["client"]: r["generation"] for r in requests.latest_generation(df).collect()} == {"a": 5, None: 2}
    stream = spark.readStream.format("rate").load().select(F.col("timestamp").alias("received_at"), F.lit("a").alias("client"), F.col("value").alias("generation"))
    assert S.latest_only(stream).isStreaming


def test_ridge(spark):
    w = np.array([[2, 3, 4], [-1, 5, 2]], np.float32)
    x = np.array([[1, 0], [0, 1], [1, 1], [2, -1]], np.float32)
    pairs = spark.createDataFrame([(f"p{i}", a.tolist(), (a @ w).tolist()) for i, a in enumerate(x)] + [("n", None, [1.0] * 3), ("odd", [1.0], [1.0] * 3)], "prompt string, source array<float>, target array<float>")
    got = distill.ridge(pairs.repartition(3), 0.0)
    assert np.abs(got - w).max() < 1e-5
    rows = {r["prompt"]: r["predicted"] for r in distill.predict(pairs, got).collect()}
    assert rows["p2"] == pytest.approx([1, 8, 6], abs=1e-4) and rows["n"] is None and rows["odd"] is None
    with pytest.raises(ValueError):
        distill.ridge(pairs.limit(0), 1.0)
    distill.check_no_leak(pairs, pairs.limit(0))
    with pytest.raises(ValueError):
        distill.check_no_leak(pairs, pairs)


def test_documents(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"fingerprint": 2**64 - 1, "entries": [{"key": "k", "path": "p", "fingerprint": 5}]}, indent=1))
    row = D.read_catalog(spark, str(tmp_path / "c.json")).first()
    assert int(row["fingerprint"]) == 2**64 - 1 and row["entries"][0]["view"] is None
    (tmp_path / "i.jsonl").write_text('{"key": "a", "tags": ["x"]}\n\n{"key": "b", "tags": []}\n')
    assert D.read_items(spark, str(tmp_path / "i.jsonl")).count() == 2
    (tmp_path / "s.json").write_text(json.dumps({"items": [{"key": "a", "tags": ["x"]}]}))
    assert D.read_sample(spark, str(tmp_path / "s.json")).first()["tags"] == ["x"]
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"id": "1", "text": "t", "requiredAny": [["a"]]}]}))
    assert D.read_queries(spark, str(tmp_path / "q.json")).first()["requiredAny"] == [["a"]]
    (tmp_path / "a.json").write_text(json.dumps({"anchors": [{"id": "1", "key": "k", "queries": ["x", "y"]}]}))
    assert D.read_anchors(spark, str(tmp_path / "a.json")).count() == 2
    D.write_document(tmp_path / "e.json", {"queries": ["a", {"text": "b"}], "acceptance": {"m": 1}})
    queries, least = D.read_held_out(spark, str(tmp_path / "e.json"))
    assert [tuple(r) for r in queries.orderBy("position").collect()] == [(0, "a"), (1, "b")] and least == {"m": 1.0}
    for broken in ({"queries": ["a", "a"]}, {"queries": []}, {"queries": ["a", {"no": "text"}]}):
        D.write_document(tmp_path / "e.json", broken, pretty=True)
        with pytest.raises(ValueError):
            D.read_held_out(spark, str(tmp_path / "e.json"))
    D.write_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).first()[0] == '{"a":1}'
    told = []
    p = D.Progress(18, lambda *x: told.append(x[0]))
    for _ in range(18):
        p.step()
    assert told == [8, 16, 18]
