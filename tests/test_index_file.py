"""The index file: round trips, damage, the Spark source, the writer."""

import io
import math
import struct

import numpy as np
import pytest

from glintframe.sources import index_file as X
from glintframe.sources.binaries import Projection, TokenTable, load_npz, write_projection, write_token_table

ROWS = [("same", 11, (0.25, 0.75)), ("same", 12, (math.nan, -0.0)), ("", 2**64 - 1, (1.0, 2.0))]


@pytest.fixture
def path(tmp_path):
    p = tmp_path / "index-1.sidx"
    X.write_index(p, "model@1", 19, ROWS, 2)
    return p


def test_round_trip(path):
    assert X.read_header(path) == X.Header(2, "model@1", 19, 3)
    got = list(X.entries(path))
    assert [(e.key, e.fingerprint) for e in got] == [(k, f) for k, f, _ in ROWS]
    assert np.stack([e.embedding for e in got]).tobytes() == np.array([v for *_, v in ROWS], "<f4").tobytes()
    assert path.with_name(path.name + X.SIDECAR).read_text() == "19"
    assert X.validate(path).count == 3
    assert X.fingerprints(path)[1] == {"same": 12, "": 2**64 - 1}
    assert X.point_lookup(path, "same").tolist() == [0.25, 0.75]
    with pytest.raises(KeyError):
        X.point_lookup(path, "none")
    assert [e.embedding for e in X.entries(path, vectors=False)] == [None] * 3
    model, keys, m = X.load_matrix(path)
    assert (model, keys, m.shape) == ("model@1", ["same", "same", ""], (3, 2))


def read_all(raw):
    r = X.Reader(io.BytesIO(raw))
    while r.left:
        r.entry()
    return r.finish()


def test_every_prefix_is_refused(path):
    raw = path.read_bytes()
    for n in range(len(raw)):
        with pytest.raises((EOFError, X.IndexFileError)):
            read_all(raw[:n])
    with pytest.raises(X.IndexFileError):
        read_all(raw + b"x")


def head(dimensions=2, model=b"m", count=0, length=None, magic=X.MAGIC):
    return magic + struct.pack("<II", dimensions, len(model) if length is None else length) + model + struct.pack("<QQ", 1, count)


@pytest.mark.parametrize("raw", [head(magic=b"12345678"), head(dimensions=0), head(model=b""), head(model=b"\xff"), head(length=2**20 + 1), head(count=1) + struct.pack("<I", 2**20 + 1), head(count=1) + struct.pack("<I", 1) + b"\xff" + bytes(16)])
def test_damaged(raw):
    with pytest.raises((EOFError, X.IndexFileError)):
        read_all(raw)


def test_empty_index_reads_but_isnt_valid(tmp_path):
    p = tmp_path / "e.sidx"
    p.write_bytes(head(dimensions=2**32 - 1))
    assert list(X.entries(p)) == []
    with pytest.raises(X.IndexFileError):
        X.validate(p)


def test_false_count(tmp_path):
    p = tmp_path / "c.sidx"
    p.write_bytes(head(count=2**64 - 1))
    with pytest.raises(X.IndexFileError):
        X.fingerprints(p)


def test_unread_entries(path):
    r = X.Reader(io.BytesIO(path.read_bytes()))
    r.skip()
    with pytest.raises(X.IndexFileError):
        r.finish()


@pytest.mark.parametrize("rows, model", [([("k", 1, (1.0,))], "m"), ([("k" * (2**20 + 1), 1, (1.0, 2.0))], "m"), ([], "m" * (2**20 + 1)), ([], ""), ([("k", -1, (1.0, 2.0))], "m")])
def test_writer_refuses_and_leaves_nothing(tmp_path, rows, model):
    with pytest.raises(X.IndexFileError):
        X.write_index(tmp_path / "w.sidx", model, 1, rows, 2)
    assert list(tmp_path.iterdir()) == []


def test_source(spark, path):
    rows = X.read_index(spark, path.parent).orderBy("position").collect()
    assert [(r["position"], r["key"], int(r["fingerprint"])) for r in rows] == [(i, k, f) for i, (k, f, _) in enumerate(ROWS)]
    assert math.isnan(rows[1]["embedding"][0]) and math.copysign(1, rows[1]["embedding"][1]) == -1
    assert X.read_index(spark, path, vectors=False).columns == ["position", "key", "fingerprint"]
    h, df = X.load_searchable(spark, path, "model@1", 2)
    assert h.count == df.count() == 3
    with pytest.raises(X.IndexFileError):
        X.load_searchable(spark, path, "model@2")
    assert X.headers(spark, [path]).first()["model"] == "model@1"


def test_export(spark, path, tmp_path):
    X.export_index(X.read_index(spark, path), tmp_path / "again.sidx", "model@1", 19, 2)
    assert (tmp_path / "again.sidx").read_bytes() == path.read_bytes()


def test_side_files(spark, tmp_path):
    write_token_table(tmp_path / "t", np.array([[10, 12], [20, 8], [9, 14]]), 0.5, 10)
    t = TokenTable(tmp_path / "t", 3, 2)
    assert t.lookup([2, 0]).ravel().tolist() == [-0.5, 2.0, 0.0, 1.0]
    for bad in (-1, 3):
        with pytest.raises(IndexError):
            t.lookup([bad])
    with pytest.raises(ValueError):
        TokenTable(tmp_path / "t", 4)
    write_projection(tmp_path / "p", np.arange(1, 7).reshape(2, 3))
    p = Projection(tmp_path / "p", 2, 3)
    assert p.apply([2, 3]).tolist() == [14, 19, 24]
    with pytest.raises(ValueError):
        p.apply([1])
    (tmp_path / "p").write_bytes((tmp_path / "p").read_bytes()[:-1])
    with pytest.raises(ValueError):
        Projection(tmp_path / "p")
    np.savez(tmp_path / "z.npz", keys=np.array(["a", "b"]), embeddings=np.eye(2, dtype=np.float32))
    assert [r["key"] for r in load_npz(spark, tmp_path / "z.npz").orderBy("position").collect()] == ["a", "b"]


def test_folder_of_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "PART_ROWS", 3)
    rows = [(i, f"k{i % 7}", i, [float(i), 1.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "position long, key string, fingerprint long, embedding array<float>")
    parts = X.export_parts(df.repartition(4), tmp_path / "parts", "m@1", 5, 2)
    assert sum(n for _, n in parts) == 20 and all(n <= 3 for _, n in parts) and all(X.validate(p).count == n for p, n in parts)
    got = sorted((int(r["fingerprint"]), r["key"], tuple(r["embedding"])) for r in X.read_index(spark, tmp_path / "parts").collect())
    assert got == [(i, k, tuple(v)) for i, k, _, v in rows]
    assert X.export_parts(df.limit(0), tmp_path / "none", "m@1", 5, 2) == []
