"""Nearest vectors, linked groups, leaves and varied subsets against brute force."""

import numpy as np
import pytest

from glintframe.llm import bisect, cells, clusters, components, neighbours, varied
from glintframe.llm.vectors import with_dimensions

from .conftest import clustered

NAN = float("nan")


def unit(m):
    m = np.asarray(m, np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def both(tables):
    e, r, h = tables
    return with_dimensions(e, h, side=0).unionByName(with_dimensions(r, h, side=1))


@pytest.fixture(scope="module")
def content():
    rng = np.random.default_rng(4)
    a = clustered(rng, 12, 25, 16, 0.08)
    b = clustered(rng, 5, 10, 9, 0.05)
    ea = [(i, v) for i, v in enumerate(a[:240])]
    ea += [(1000 + i, a[3]) for i in range(9)] + [(2000, a[5] * 3)]
    ea += [(3000, None), (3001, a[0][:5]), (3002, [NAN] * 16), (3003, [None] + [1.0] * 15), (3004, [0.0] * 16), (3005, [float("inf")] * 16)]
    ra = [(5000 + i, v) for i, v in enumerate(a[240:])] + [(5900 + i, a[3]) for i in range(4)] + [(5990, a[7] * 0.01), (5991, [0.0] * 16)]
    eb, rb = [(10000 + i, v) for i, v in enumerate(b[:40])], [(11000 + i, v) for i, v in enumerate(b[40:])]
    return {"a": (16, ea, ra), "b": (9, eb, rb), "none": (4, [], [(12000, [1.0, 0, 0, 0])])}


def good(rows, width):
    return [(i, np.asarray(v, np.float64)) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v) and any(v)]


@pytest.mark.parametrize("rows_per_cell, unit_rows, part_bytes", [(256, 16_384, 6 << 20), (16, 16_384, 6 << 20), (16, 20, 500), (60, 7, 6 << 20), (60, 100, 300)])
def test_nearest(spark, vector_tables, content, monkeypatch, rows_per_cell, unit_rows, part_bytes):
    monkeypatch.setattr(neighbours, "PART_BYTES", part_bytes)
    want = set()
    for width, e, r in content.values():
        e, r = good(e, width), good(r, width)
        if not e or not r:
            continue
        s = np.round(unit([v for _, v in r]) @ unit([v for _, v in e]).T, 12)
        for (q, _), row in zip(r, s, strict=True):
            best = sorted((-x, i) for x, (i, _) in zip(row, e, strict=True) if x >= 0.9)[:5]
            want |= {(q, i) for _, i in best}
    got = [(r["query_id"], r["vec_id"]) for r in neighbours.nearest_vectors(both(vector_tables(content)), 5, 0.9, rows_per_cell=rows_per_cell, unit_rows=unit_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("unit_rows, part_bytes", [(65_536, 6 << 20), (20, 6 << 20), (65_536, 300), (40, 200)])
def test_linked_groups(spark, vector_tables, content, monkeypatch, unit_rows, part_bytes):
    monkeypatch.setattr(clusters, "PART_BYTES", part_bytes)
    monkeypatch.setattr(clusters, "UNIT_ROWS", unit_rows)
    monkeypatch.setattr(clusters, "ROWS_PER_LEAF", 8)
    want = set()
    for width, e, r in content.values():
        rows = sorted(good(e, width) + good(r, width), key=lambda x: x[0])
        if len(rows) < 3:
            continue
        s = unit([v for _, v in rows]) @ unit([v for _, v in rows]).T >= 0.9
        label = list(range(len(rows)))
        for _ in range(len(rows)):
            new = [min(label[j] for j in np.flatnonzero(s[i])) for i in range(len(rows))]
            if new == label:
                break
            label = new
        for i in range(len(rows)):
            if label.count(label[i]) >= 3 and label[i] != i:
                want.add((rows[label[i]][0], rows[i][0]))
    got = [tuple(r) for r in clusters.linked_groups(both(vector_tables(content)), 0.9, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_layout():
    """Units that many rows probe get several tasks; a small unit shares a partition."""
    c = cells.Cells(0, 4, np.zeros((3, 4), np.float32), np.array([10.0, 10, 40_000]), np.ones(3), b"", np.array([0, 1, 2]), np.array([1, 1, 3]))
    out = cells.lay_out({"a": c}, {1: 15e6, 3: 1.0}, 6 << 20)
    assert out.parts.tolist() == [1, 3, 1, 1, 1] and out.first.tolist() == [0, 1, 4, 5, 6]
    assert out.primary.tolist() == [True, True, False, False, True, True, True]
    assert out.partition[0] == out.partition[1] and out.partitions == out.partition[-1] + 1 == 2
    row, task = out.homes(np.array([0, 1, 4]))
    assert row.tolist() == [0, 1, 1, 1, 2] and task.tolist() == [0, 1, 2, 3, 6]
    asked = out.asked(np.full(900, 1), np.arange(900))
    assert set(asked.tolist()) == {1, 2, 3} and np.bincount(asked).max() < 400


def test_nothing(spark, vector_tables):
    empty = both(vector_tables({"a": (4, [], [])}))
    unusable = both(vector_tables({"a": (4, [(1, [NAN] * 4), (2, [0.0] * 4)], [(3, None)])}))
    for v in (empty, unusable):
        assert neighbours.nearest_vectors(v, 5, 0.9).count() == 0
        assert clusters.linked_groups(v, 0.9, 3).count() == 0
        assert clusters.leaf_members(v).count() == 0
        assert varied.varied_subset(v, 5).count() == 0


def test_equal_vectors_make_one_group(spark, vector_tables):
    v = both(vector_tables({"a": (4, [(i, [1.0, 2, 3, 4]) for i in range(300)], [])}))
    got = sorted(tuple(r) for r in clusters.linked_groups(v, 0.9, 3).collect())
    assert got == [(0, i) for i in range(1, 300)]


def test_leaves(spark, vector_tables, content):
    v = both(vector_tables(content))
    members = clusters.leaf_members(v).collect()
    usable = sum(len(good(rows, c[0])) for c in content.values() for rows in c[1:])
    assert len(members) == usable == len({r["vec_id"] for r in members})
    rows = clusters.describe_leaves(clusters.leaf_members(v), 2).collect()
    sizes = {(r["index_name"], r["leaf"]): r["size"] for r in rows}
    assert sum(sizes.values()) == usable
    assert all(r["rank"] <= 2 for r in rows)


def test_leaves_are_compact():
    x = bisect.unit_rows(clustered(np.random.default_rng(1), 8, 40, 12, 0.02))
    c = bisect.fit_leaves(x, 64, 4, 0.95)
    assert len(c) == 8 and (x @ c.T).max(axis=1).min() >= 0.95
    assert len(bisect.fit_leaves(np.ones((5, 3), np.float32) / np.sqrt(np.float32(3)), 4, 1)) == 1
    assert bisect.fit_leaves(np.zeros((0, 3), np.float32), 4, 1).shape == (0, 3)


@pytest.mark.parametrize("unit_rows", [65_536, 20])
def test_every_leaf_is_compact(spark, vector_tables, monkeypatch, unit_rows):
    """More kinds than first-level leaves, fitted on a sample that misses most of them."""
    monkeypatch.setattr(clusters, "UNIT_ROWS", unit_rows)
    monkeypatch.setattr(clusters.C, "SAMPLE_ROWS", 40)
    x = np.vstack([clustered(np.random.default_rng(5), 90, 3, 24, 0.01), np.tile(clustered(np.random.default_rng(6), 1, 1, 24, 0), (60, 1))])
    rows = clusters.leaf_members(both(vector_tables({"a": (24, list(enumerate(x)), [])}))).collect()
    assert sorted(r["vec_id"] for r in rows) == list(range(330))
    assert min(r["similarity"] for r in rows) >= 0.95
    kinds = {}
    for r in rows:
        kinds.setdefault(r["leaf"], set()).add(min(r["vec_id"] // 3, 90))
    assert all(len(k) == 1 for k in kinds.values()) and len(kinds) >= 91
    for leaf in kinds:
        own = unit(x[[r["vec_id"] for r in rows if r["leaf"] == leaf]])
        assert (own @ own.sum(axis=0) / np.linalg.norm(own.sum(axis=0))).min() >= 0.95


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2300)]
    parent = np.arange(3000)
    a, b = np.array(edges).T
    components.unite(parent, a, b)
    root = components.roots(parent, np.arange(3000))
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {n: int(root[n]) for n in linked}


def test_varied_subset(spark, vector_tables):
    rng = np.random.default_rng(6)
    # 20 kinds, one of them with most of the rows
    centres = np.linalg.qr(rng.standard_normal((32, 32)))[0][:20]
    rows = [(i, centres[0] + 0.02 * rng.standard_normal(32)) for i in range(500)]
    rows += [(1000 + 10 * k + j, centres[k] + 0.02 * rng.standard_normal(32)) for k in range(1, 20) for j in range(4)]
    v = both(vector_tables({"a": (32, rows, [])})).repartition(5)
    got = varied.varied_subset(v, 20, block=8).orderBy("pick").collect()
    kinds = [0 if r["vec_id"] < 1000 else (r["vec_id"] - 1000) // 10 for r in got]
    assert [r["pick"] for r in got] == list(range(1, 21))
    assert sorted(kinds) == list(range(20))


def test_varied_subset_of_few(spark, vector_tables):
    v = both(vector_tables({"a": (3, [(i, [1.0, 0, 0]) for i in range(9)] + [(20, [0, 1.0, 0])], []), "b": (2, [(30, [1.0, 1.0])], [])}))
    got = {(r["index_name"], r["pick"], r["vec_id"]) for r in varied.varied_subset(v, 5).collect()}
    # near copies fill up what is asked for, after all others
    assert got == {("a", 1, 0), ("a", 2, 20), ("a", 3, 1), ("a", 4, 2), ("a", 5, 3), ("b", 1, 30)}
    for wrong in ({}, {"k": 0}, {"k": 2, "share": 0.5}, {"share": 1.5}):
        with pytest.raises(ValueError):
            varied.varied_subset(v, **wrong)


@pytest.mark.parametrize("region_picks, unit_rows", [(256, 32_768), (8, 32_768), (8, 30)])
def test_varied_share(spark, vector_tables, monkeypatch, region_picks, unit_rows):
    """A share of the index, by regions and by tournaments of many nodes: all kinds come before second members of one."""
    monkeypatch.setattr(varied, "REGION_PICKS", region_picks)
    monkeypatch.setattr(varied, "UNIT_ROWS", unit_rows)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 24))
    kind = np.concatenate([np.zeros(400, int), np.repeat(np.arange(1, 40), 10)])
    x = centres[kind] + 0.02 * rng.standard_normal((len(kind), 24))
    v = both(vector_tables({"a": (24, [(i, r) for i, r in enumerate(x)] + [(5000, [NAN] * 24)], [])})).repartition(4)
    got = varied.varied_subset(v, share=0.05, block=16).orderBy("pick").collect()
    assert [r["pick"] for r in got] == list(range(1, 41)) and len({r["vec_id"] for r in got}) == 40
    assert len({int(kind[r["vec_id"]]) for r in got}) >= 38
    members = varied.represented(v, share=0.05, block=16).collect()
    assert sorted(r["vec_id"] for r in members) == list(range(len(x)))
    picks = {r["pick_vec_id"]: r["pick"] for r in members}
    assert picks == {r["vec_id"]: r["pick"] for r in got}
    assert all(r["pick_vec_id"] == r["vec_id"] and r["similarity"] > 0.9999 for r in members if r["vec_id"] in picks)
    assert sum(kind[r["vec_id"]] == kind[r["pick_vec_id"]] for r in members) >= 0.97 * len(x)


def test_hardly_usable_index(spark, vector_tables, monkeypatch):
    """An index whose sample holds no usable row loses none of its usable ones."""
    monkeypatch.setattr(clusters.C, "SAMPLE_ROWS", 3)
    rows = [(i, [NAN] * 4) for i in range(3000)] + [(5000 + i, [1.0, 2, 3, 4 + i / 100]) for i in range(3)]
    v = both(vector_tables({"a": (4, rows, [])}))
    assert sorted(tuple(r) for r in clusters.linked_groups(v, 0.9, 3).collect()) == [(5000, 5001), (5000, 5002)]
    assert varied.varied_subset(v, 2).count() == 2


def test_table_scan_scores():
    """A scan's score is off by no more than the bound that reranking relies on."""
    rng = np.random.default_rng(3)
    x = bisect.unit_rows(clustered(rng, 6, 60, 63, 0.1))
    c = bisect.fit_leaves(x, 6, 4)
    own = c[(x @ c.T).argmax(axis=1)]
    book = np.frombuffer(neighbours.train_book(x, own), np.float32).reshape(-1, 16, 2)
    r = neighbours._padded(x - own)
    scale = np.linalg.norm(r, axis=1)
    codes = neighbours.encode(r / scale[:, None], neighbours._padded(x), book, neighbours.eta(63))
    assert codes.max() < 16
    err = (r - neighbours.decode(codes, book) * scale[:, None])[:, :63]
    assert (err**2).sum() < 0.5 * (r**2).sum()
    plain = neighbours.encode(r / scale[:, None], neighbours._padded(x), book, 1.0)
    along = lambda k: np.abs(((r - neighbours.decode(k, book) * scale[:, None])[:, :63] * x).sum(axis=1)).mean()
    assert along(codes) < along(plain)
