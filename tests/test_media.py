"""Views, patch grids, pixels, tokens, encoders, manifests, hashes and packs."""

import json

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.functions import encoders, hashing, images, templates, text, views
from glintframe.operators import registry as G
from glintframe.sources import files, manifest


def test_views_and_grids(spark):
    assert views.view_rectangle(6, 2, "full") == (0, 0, 6, 2) and views.view_rectangle(6, 2, "center") == (2, 0, 2, 2)
    assert views.view_rectangle(6, 2, "leftThird") == (0, 0, 2, 2) and views.view_rectangle(6, 2, "rightThird") == (4, 0, 2, 2)
    sizes = [(360, 640), (480, 2560), (1440, 2560), (100, 600), (90, 160)]
    grids = [(12, 21), (7, 36), (12, 21), (6, 36), (12, 21)]
    assert [views.patch_grid(h, w, 16, 256) for h, w in sizes] == grids
    df = spark.createDataFrame([*sizes, (0, 1)], "h int, w int").select(views.patch_grid_column(F.col("h"), F.col("w"), 16, 256).alias("g"))
    assert [tuple(r["g"]) if r["g"] else None for r in df.collect()] == [*grids, None]
    # of every step of the scales the last one whose grid fits
    odd = [(1, 1, 16, 1), (7, 3000, 14, 100), (5000, 5000, 16, 1), (33, 64, 32, 12), (2, 3, 16, 5)]
    for h, w, patch, most in odd:
        side = lambda k, size: np.maximum(1, np.ceil(size * (1e-6 + k * ((100.0 - 1e-6) / 2**24)) / patch))  # noqa: B023, E731
        k = np.arange(2**24)
        last = np.flatnonzero(side(k, h) * side(k, w) <= most)[-1]
        assert views.patch_grid(h, w, patch, most) == (side(last, h), side(last, w))
        found = spark.createDataFrame([(h, w)], "h int, w int").select(views.patch_grid_column(F.col("h"), F.col("w"), patch, most).alias("g")).first()["g"]
        assert tuple(found) == (side(last, h), side(last, w))
    with pytest.raises(ValueError):
        views.patch_grid(0, 1, 16, 256)
    pics = spark.createDataFrame([("static:wide", 600, 100), ("static:plain", 160, 90), ("live:wide", 600, 100)], "key string, width int, height int")
    got = views.expand_views(pics, 2.0).groupBy("key").agg(F.collect_list("view").alias("v")).collect()
    assert {r["key"]: len(r["v"]) for r in got} == {"static:wide": 4, "static:plain": 2, "live:wide": 2}


def png(m):
    raw = b"".join(b"\0" + row.tobytes() for row in m)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", m.shape[1], m.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pixels(spark, tmp_path):
    m = np.random.default_rng(1).integers(0, 256, (7, 11, 3), dtype=np.uint8)
    ppm = b"P6\n# note\n11 7\n255\n" + m.tobytes()
    plain = b"P3 11 7 255\n" + " ".join(map(str, m.ravel())).encode()
    for raw in (png(m), ppm, plain):
        assert (images.decode(raw) == m).all()
    for name, raw in (("a.png", png(m)), ("b.ppm", ppm), ("c.png", b"broken")):
        (tmp_path / name).write_bytes(raw)
    rows = {r["path"].rsplit("/")[-1]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert bytes(rows["a.png"]["rgb"]) == m.tobytes() == bytes(rows["b.ppm"]["rgb"]) and (rows["a.png"]["width"], rows["a.png"]["height"]) == (11, 7)
    assert rows["c.png"]["error"] and rows["c.png"]["rgb"] is None


def test_resampling():
    flat = np.full((9, 5, 3), 77, np.uint8)
    for kind in images.FILTERS:
        assert (images.resize(flat, 13, 4, kind) == 77).all()
    m = np.random.default_rng(2).integers(0, 256, (8, 8, 3), dtype=np.uint8)
    assert (images.resize(m, 8, 8) == m).all()
    assert images.fit(m, 4, 2).shape == (2, 4, 3) and images.fit(m, 3, 5, "stretch").shape == (5, 3, 3)
    assert images.fit(np.zeros((3, 7, 3), np.uint8), 5, 5, rounding=round).shape == (5, 5, 3)
    t = images.tensor(np.full((2, 2, 3), 255, np.uint8), (0.5,) * 3, (0.5,) * 3)
    assert t.shape == (3, 2, 2) and (t == 1).all()
    p = images.patches(np.arange(4 * 4 * 3, dtype=np.uint8).reshape(4, 4, 3), (0,) * 3, (1,) * 3, 2, 6)
    assert p.shape == (6, 12) and (p[4:] == 0).all() and p[1][0] == pytest.approx(6 / 255)
    values, mask, grid = images.patch_input(m, (0,) * 3, (1,) * 3, 2, 16, [(4, 4)])
    assert grid == (4, 4) and mask.sum() == 16 and values.shape == (16, 12)
    with pytest.raises(ValueError):
        images.patch_input(m, (0,) * 3, (1,) * 3, 2, 16, [(1, 1)])


def test_framing(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2, 3, 4],), ([1, 2, 3, 4, 5, 6],), ([],)], "ids array<long>")
    for always, ends in ((False, [[1, 2, 0, 0], [1, 2, 3, 4], [1, 2, 3, 9], [0] * 4]), (True, [[1, 2, 0, 0], [1, 2, 3, 9], [1, 2, 3, 9], [0] * 4])):
        ids, mask = text.frame_ids(F.col("ids"), 4, 9, 0, always)
        rows = df.select(ids.alias("i"), mask.alias("m")).collect()
        assert [r["i"] for r in rows] == ends and [sum(r["m"]) for r in rows] == [2, 4, 4, 0]
    assert text.frame([1, 2, 3], [1, 1, 1], 2, 9) == ([1, 9], [1, 1])
    ids, mask = text.encode_ids("/opt/tokenizers/word_bpe_49k.json", "A red fox")
    assert len(ids) == len(mask) >= 3


def test_hashes(spark):
    assert hashing.cache_name("siglip2@example", "full") == "index-4996a02d76bcc887.sidx"
    assert hashing.cache_name("siglip2@example", "multiview") == "index-4cda89ea7a131e82.sidx"
    assert hashing.component_name("facebook/PE-Core-L14-336", "2026-08-26") == "facebook-pe-core-l14-336-2026-08-26-7189c32ecba4038c"
    assert len({hashing.view_fingerprint("/a", 1, 2, v) for v in views.VIEWS}) == 4
    df = spark.createDataFrame([("m", "p"), (None, "p")], "m string, p string").select(hashing.cache_name_column(F.col("m"), F.col("p")).alias("n")).collect()
    assert [r["n"] for r in df] == [hashing.cache_name("m", "p"), None]
    entries = spark.createDataFrame([(1, 1, "b", 2), (1, 0, "a", 1), (2, 0, None, 1)], "build_id long, position int, key string, fingerprint long")
    got = {r["build_id"]: int(r["fingerprint"]) for r in hashing.catalog_fingerprints(entries, "build_id").collect()}
    assert got == {1: hashing.catalog_fingerprint([("a", 1), ("b", 2)])}


def test_templates(spark):
    words = {"c": spark.createDataFrame([("red",), ("blue",), (None,)], "w string"), "t": spark.createDataFrame([("fox",)], "w string")}
    got = {r[0] for r in templates.expand(spark, ["a {c} {t}", "{t}"], words, ["fixed"]).collect()}
    assert got == {"a red fox", "a blue fox", "fox", "fixed"}
    df = spark.createDataFrame([("libonnxruntime.so.1.22.0",), ("other",)], "n string")
    assert [r[0] for r in df.select(templates.runtime_version(F.col("n"))).collect()] == ["1.22.0", None]
    p = spark.createDataFrame([(f"p{i}",) for i in range(200)], "prompt string")
    split = templates.seeded_split(p, 0.8, 3)
    assert 0.65 < split.filter("training").count() / 200 < 0.95
    assert templates.seeded_sample(p, 5, 1).collect() == templates.seeded_sample(p.repartition(7), 5, 1).collect()
    k = spark.createDataFrame([("static:a/b.png", "/x"), ("live", "/y")], "k string, p string")
    assert [r[0] for r in k.select(templates.source_path(F.col("k"), F.col("p"), "/root")).collect()] == ["/root/a/b.png", "/y"]


def field(number, body):
    body = body if isinstance(body, bytes) else body.encode()
    return varint(number << 3 | 2) + varint(len(body)) + body


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def identity_model(shape, kind=1, source="x", target="y"):
    """An ONNX model that hands its input on."""
    dims = b"".join(field(1, varint(1 << 3) + varint(d)) for d in shape)
    info = lambda name: field(1, name) + field(2, field(1, varint(1 << 3) + varint(kind) + field(2, dims)))
    graph = field(1, field(1, source) + field(2, target) + field(4, "Identity")) + field(2, "g") + field(11, info(source)) + field(12, info(target))
    return varint(1 << 3) + varint(8) + field(7, graph) + field(8, varint(2 << 3) + varint(16))


TOKENIZER = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": {"[UNK]": 0, "test": 1}, "unk_token": "[UNK]"}}


def make_pack(folder, version="1", marker="a"):
    folder.mkdir(parents=True)
    (folder / "image.onnx").write_bytes(identity_model((1, 3, 1, 1)))
    (folder / "text.onnx").write_bytes(identity_model((1, 3), 7, "tokens", "text_embedding"))
    (folder / "tokenizer.json").write_text(json.dumps(TOKENIZER))
    (folder / "marker.txt").write_text(marker)
    value = {"format": 1, "id": "test/model", "version": version, "dimensions": 3, "contextLength": 3, "image": {"model": "image.onnx", "width": 1, "height": 1, "mean": [0, 0, 0], "std": [1, 1, 1], "input": "x", "output": "y"}, "text": {"model": "text.onnx", "tokenizer": "tokenizer.json", "eosToken": 1}}
    (folder / manifest.FILE_NAME).write_text(json.dumps(value))
    return folder


def test_encoders(spark, tmp_path):
    m = manifest.load(make_pack(tmp_path / "p") / manifest.FILE_NAME)
    assert m.identity == manifest.identity(tmp_path / "p" / manifest.FILE_NAME) == "test/model@1"
    manifest.require_same_pack(m, m)
    with pytest.raises(ValueError):
        manifest.require_same_pack(m, manifest.load(make_pack(tmp_path / "q", "2") / manifest.FILE_NAME))
    assert encoders.OnnxTextEncoder(m)("test other test test").tolist() == [1.0, 0.0, 1.0]
    pixel = b"P3 1 1 255\n255 0 51"
    assert encoders.OnnxImageEncoder(m)(pixel).tolist() == pytest.approx([1.0, 0.0, 0.2])
    df = spark.createDataFrame([("red fox",), (None,), ("",)], "t string")
    rows = encoders.encode_texts(df, "t", encoders.hashing_factory(8)).collect()
    assert len(rows[0]["vector"]) == 8 and rows[1]["vector"] is None and rows[1]["encode_error"] is None
    pics = spark.createDataFrame([(bytearray(pixel), "full"), (bytearray(b"zz"), "full")], "content binary, view string")
    out = encoders.encode_images(pics, "content", "view", lambda: encoders.OnnxImageEncoder(m)).collect()
    assert len(out[0]["embedding"]) == 3 and out[1]["error"] == "unknown image format"


@pytest.mark.parametrize("change", [{"format": 2}, {"id": " "}, {"dimensions": 0}, {"contextLength": 1}, {"image": {}}, {"image": {"model": "m", "width": 0, "height": 1, "mean": [0] * 3, "std": [1] * 3}}, {"image": {"model": "m", "width": 1, "height": 1, "mean": [0] * 3, "std": [0] * 3}}, {"image": {"model": "m", "width": 1, "height": 1, "mean": [0] * 3, "std": [1] * 3, "patchSize": 2}}])
def test_bad_manifests(tmp_path, change):
    path = make_pack(tmp_path / "p") / manifest.FILE_NAME
    path.write_text(json.dumps(json.loads(path.read_text()) | change))
    with pytest.raises(ValueError):
        manifest.load(path)


def test_pack_life(spark, tmp_path):
    r = G.Registry(tmp_path / "models")
    with pytest.raises(G.PackError):
        r.resolve()
    one = r.put(make_pack(tmp_path / "a", "1"))
    assert r.resolve("test/model") == one == r.resolve()
    with pytest.raises(G.PackError) as e:
        r.put(tmp_path / "a")
    assert e.value.code == "install_refused"
    two = r.put(make_pack(tmp_path / "b", "2"), "update")
    assert {p.version: p.role for p in r.installed()} == {"1": "previous", "2": "active"}
    assert r.rollback("test/model") == one and r.rollback("test/model") == two
    again = r.put(make_pack(tmp_path / "c", "2", "other"), "replace")
    assert again.name == two.name + "-r1" and r.table(spark).filter("role = 'inactive'").count() == 1
    with pytest.raises(G.PackError):
        r.remove("test/model", component=again.name)
    assert r.remove("test/model", component=two.name) == two.name
    assert r.doctor("test/model")["ok"] and not r.doctor("none")["ok"]
    (again / "marker.txt").write_text("tampered")
    assert [p.issue for p in r.installed() if p.role == "active"] == ["files_changed"]
    assert r.remove("test/model", component=again.name, allow_active=True) == again.name and r.ledger()["packs"] == {}


def test_failed_changes_leave_the_old_state(tmp_path, monkeypatch):
    r = G.Registry(tmp_path / "models")
    one = r.put(make_pack(tmp_path / "a", "1"))
    before = r.ledger()
    monkeypatch.setattr(r, "_save", lambda state: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        r.put(make_pack(tmp_path / "b", "2"), "update")
    with pytest.raises(OSError):
        r.remove("test/model", allow_active=True)
    monkeypatch.undo()
    assert r.ledger() == before and [p.component for p in r.installed()] == [one.name] and r.installed()[0].healthy


def test_repair(tmp_path):
    r = G.Registry(tmp_path / "models")
    r.put(make_pack(tmp_path / "a", "1"))
    (tmp_path / "models" / G.LEDGER).write_text("{")
    with pytest.raises(G.PackError):
        r.ledger()
    assert not r.doctor("test/model")["ok"]
    assert r.repair() == ["test/model"] and (tmp_path / "models" / f"{G.LEDGER}.bad-1").exists()
    assert r.doctor("test/model")["ok"]


def test_archive_and_manifest_removal(tmp_path, capsys):
    import tarfile

    folder = make_pack(tmp_path / "a", "3")
    with tarfile.open(tmp_path / "p.tar", "w") as t:
        t.add(folder, "inner")
    assert G.main([str(tmp_path / "models"), "install", str(tmp_path / "p.tar")]) == 0
    assert G.main([str(tmp_path / "models"), "install", str(tmp_path / "p.tar")]) == 1
    assert "install_refused" in capsys.readouterr().out
    (folder / "other.json").write_text(json.dumps(json.loads((folder / manifest.FILE_NAME).read_text()) | {"version": "9"}))
    assert G.remove_manifest(folder / manifest.FILE_NAME) == [manifest.FILE_NAME]
    assert (folder / "image.onnx").exists()
    G.remove_manifest(folder / "other.json")
    assert sorted(p.name for p in folder.iterdir()) == ["marker.txt"]


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b").write_bytes(b"x")
    (tmp_path / "a").write_bytes(b"yy")
    tree = files.scan_tree(tmp_path)
    assert [f["path"] for f in tree] == ["a", "d/b"] and sum(f["bytes"] for f in tree) == 3
    table = files.file_table(spark, str(tmp_path))
    assert {r["sha256"] for r in table.collect()} == {f["sha256"] for f in tree}
    assert tuple(files.total_bytes(table).first()) == (2, 3)
    for kw in ({"max_entries": 1}, {"max_bytes": 1}):
        with pytest.raises(ValueError):
            files.scan_tree(tmp_path, **kw)
    (tmp_path / "link").symlink_to(tmp_path / "a")
    with pytest.raises(ValueError):
        files.scan_tree(tmp_path)
    tensor = lambda path: field(13, field(1, "location") + field(2, path))
    inner = field(5, field(6, field(5, tensor("deep.bin"))))
    model = field(7, field(5, tensor("a.bin")) + field(5, tensor("a.bin")) + field(1, inner))
    assert files.external_files(model) == ["a.bin", "deep.bin"]
    for bad in (field(7, field(5, tensor("../x"))), model[:-1]):
        with pytest.raises(ValueError):
            files.external_files(bad)
    deep = field(5, tensor("x"))
    for _ in range(70):
        deep = field(1, field(5, field(6, deep)))
    with pytest.raises(ValueError):
        files.external_files(field(7, deep))
    assert files.memory_mib() > 1 and files.memory_mib(2**30) == 0


def test_tags_of_sqlite(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "t.db") as c:
        c.execute("CREATE TABLE meta (key TEXT, generated_tags TEXT)")
        c.executemany("INSERT INTO meta VALUES (?, ?)", [("a", "x, y"), ("b", None)])
    assert [tuple(r) for r in files.tag_table(spark, tmp_path / "t.db").collect()] == [("a", "x, y")]




def test_tiff(spark, tmp_path):
    """A baseline TIFF of one strip, as the JVM reads it."""
    rgb = np.arange(3 * 4 * 3, dtype=np.uint8).reshape(3, 4, 3)
    tags = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 3, 8 + 2 + 9 * 12 + 4), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 8 + 2 + 9 * 12 + 4 + 6), (277, 3, 1, 3), (278, 3, 1, 3), (279, 4, 1, 36)]
    body = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0) + struct.pack("<3H", 8, 8, 8) + rgb.tobytes()
    (tmp_path / "a.tif").write_bytes(body)
    (tmp_path / "b.tiff").write_bytes(b"II*\x00broken")
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert (got["a.tif"]["width"], got["a.tif"]["height"], got["a.tif"]["error"]) == (4, 3, None) and bytes(got["a.tif"]["rgb"]) == rgb.tobytes()
    assert got["b.tiff"]["rgb"] is None and got["b.tiff"]["error"]
