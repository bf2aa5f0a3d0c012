"""Similarity clusters: leaves of a bisecting k-means tree, and the groups that links within and between leaves make.

The first levels of the tree split the node of the largest dispersion of a
sample, until the leaves are compact (``COMPACT``) or their number is reached.
:func:`leaf_members` goes on from there over all rows until every row lies
within ``COMPACT`` of the centre of its leaf; these leaves, their sizes and
their centre-nearest members (:func:`describe_leaves`) are a result of their
own.  :func:`linked_groups` takes the first levels as cells and adds an exact check to the leaves: members of a leaf within half the link
angle of its centre are all linked with each other (triangle inequality); all
other pairs within a leaf, and between a leaf and the vectors near it, are
compared.  A leaf of any size that is compact needs no pair at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import checkpointed
from . import cells as C
from .bisect import compact_leaves, unit_rows
from .bisect import fit_leaves as bisecting
from .components import connected_components, roots, unite
from .neighbours import home_rows, routed
from .vectors import as_binary, from_binary, usable_rows

#: Least cosine to the centre at which a leaf counts as compact.
COMPACT = 0.95
#: Rows for each leaf of the first levels.
ROWS_PER_LEAF = 64
UNIT_ROWS = 65_536
#: Bytes of probing rows of a task.
PART_BYTES = 16 << 20
Z = 3.0
_EDGE = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
_MARGIN = 4e-6
#: Most nodes that one pass makes of a node too large for a task, and bits of a leaf's number within its node.
PASS_NODES = 64
_LEAF_BITS = 16
_LABEL, _LINK, _SELF = 0, 1, 2


def _core_cosine(min_similarity: float) -> float:
    """Cosine of half the link angle: two vectors that near a centre are linked."""
    return float(np.cos(np.arccos(min_similarity) / 2)) + 2e-6


def _edges(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], schema=_EDGE)


class LinkBlock:
    """The vectors of a unit with the sets that links make of them.

    Where several tasks hold a unit, each finds the same sets before any
    vector asks; the ``primary`` one reports them, all report what askers join.
    """

    def __init__(self, cells: C.Cells, min_similarity: float, primary: bool = True):
        self.primary = primary
        self.cells, self.min, self.core_cos = cells, min_similarity, _core_cosine(min_similarity)
        self.parts: list[tuple] = []
        self.ready = False
        self.asked: list[np.ndarray] = []
        self.hit: list[np.ndarray] = []

    def add(self, ident, cell, core, raw) -> None:
        self.parts.append((ident, cell, core, raw))

    def _prepare(self) -> None:
        self.ready = True
        ident, cell, core, raw = (np.concatenate([p[k] for p in self.parts]) for k in range(4))
        order = np.lexsort((ident, ~core, cell))
        self.ids, self.cell, self.core, self.raw = ident[order], cell[order], core[order], raw[order]
        self.x = unit_rows(self.raw)
        self.parent = np.arange(len(order))
        ids, starts = np.unique(self.cell, return_index=True)
        self.spans = {}
        for c, a, b in zip(ids.tolist(), starts.tolist(), np.append(starts[1:], len(order)).tolist(), strict=True):
            k = a + int(self.core[a:b].sum())
            self.spans[c] = (a, k, b)
            if k > a:
                self.parent[a:k] = a
        for c, (a, k, b) in self.spans.items():
            step = max(1, (4 << 20) // max(1, b - a))
            for i in range(k, b, step):
                j = min(b, i + step)
                self._link(self.x[i:j], self.raw[i:j], c, np.arange(i, j))
        self.base = roots(self.parent, np.arange(len(order))).copy()

    def _exact(self, raw: np.ndarray, w: np.ndarray, e: np.ndarray) -> np.ndarray:
        x, y = raw[w].astype(np.float64), self.raw[e].astype(np.float64)
        s = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        return s >= self.min

    def _pairs(self, x, raw, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Linked (row of x, own row) among own rows a..b."""
        s = x @ self.x[a:b].T
        w, e = np.nonzero(s >= self.min - _MARGIN)
        near = s[w, e] < self.min + _MARGIN
        if near.any():
            sure = ~near
            sure[near] = self._exact(raw, w[near], a + e[near])
            w, e = w[sure], e[sure]
        return w, a + e

    def _link(self, x: np.ndarray, raw: np.ndarray, c: int, nodes: np.ndarray | None) -> np.ndarray:
        """Joins what the rows of ``x`` are linked with in cell c, and the rows themselves where they are own ``nodes``.

        Gives one linked own row for each row, or -1.
        """
        a, k, b = self.spans[c]
        first = np.full(len(x), -1)
        if k > a:
            inside = x @ self.cells.centres[c] >= self.core_cos
            first[inside] = a
            rest = np.flatnonzero(~inside)
            if len(rest):
                s = x[rest] @ self.x[a:k].T
                best = s.argmax(axis=1)
                top = s[np.arange(len(rest)), best]
                yes = top >= self.min + _MARGIN
                for r in np.flatnonzero(~yes & (top >= self.min - _MARGIN)):
                    e = np.flatnonzero(s[r] >= self.min - _MARGIN)
                    yes[r] = self._exact(raw, np.full(len(e), rest[r]), a + e).any()
                first[rest[yes]] = a
        if b > k:
            w, e = self._pairs(x, raw, k, b)
            fresh = first[w] < 0
            first[w[fresh][::-1]] = e[fresh][::-1]
            unite(self.parent, first[w], e)
        if nodes is not None:
            hit = first >= 0
            unite(self.parent, nodes[hit], first[hit])
        return first

    def ask(self, ident: np.ndarray, raw: np.ndarray, probed: np.ndarray, at: np.ndarray) -> None:
        if not self.parts:
            return
        if not self.ready:
            self._prepare()
        x = unit_rows(raw)
        who = np.repeat(np.arange(len(ident)), np.diff(at))
        order = np.argsort(probed, kind="stable")
        who, what = who[order], probed[order]
        first = np.full(len(ident), -1)
        for c in np.unique(what):
            if c not in self.spans:
                continue
            a, _, b = self.spans[c]
            qs = who[np.searchsorted(what, c) : np.searchsorted(what, c, "right")]
            step = max(1, (4 << 20) // max(1, b - a))
            for i in range(0, len(qs), step):
                q = qs[i : i + step]
                hit = self._link(x[q], raw[q], int(c), None)
                both = (first[q] >= 0) & (hit >= 0)
                unite(self.parent, first[q[both]], hit[both])
                first[q] = np.where(first[q] >= 0, first[q], hit)
        got = first >= 0
        self.asked.append(ident[got])
        self.hit.append(first[got])

    def finish(self) -> Iterator[pa.RecordBatch]:
        """Labels (own vector, first vector of its set) and links (asking vector or set, set), as nodes; sets of one vector that are linked are told apart."""
        if not self.parts:
            return
        if not self.ready:
            self._prepare()
        node = self.ids * 2
        base = np.unique(self.base)
        now = roots(self.parent, base)
        joined = base != now
        asked = np.concatenate(self.asked or [np.zeros(0, np.int64)])
        hit = self.base[np.concatenate(self.hit or [np.zeros(0, np.int64)])]
        anchors, held = [], []
        for c, (a, k, _) in self.spans.items():
            if self.primary and k > a and self.cells.splits[c] > 1:
                anchors.append(2 * (self.cells.number * C.MAX_CELLS + c) + 1)
                held.append(self.base[a])
        size = np.bincount(self.base, minlength=len(node))
        if self.primary:
            some = size[self.base] > 1
            yield _edges(_LABEL, node[some], node[self.base[some]])
        touched = np.unique(np.concatenate([hit, base[joined], self.base[now[joined]], np.array(held, np.int64)]).astype(np.int64))
        alone = touched[size[touched] == 1]
        yield _edges(_SELF, node[alone], node[alone])
        yield _edges(_LINK, asked * 2, node[hit])
        yield _edges(_LINK, node[base[joined]], node[self.base[now[joined]]])
        yield _edges(_LINK, np.array(anchors, np.int64), node[np.array(held, np.int64)])


def _router(model, layout, min_similarity: float, z: float):
    core_cos = _core_cosine(min_similarity)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks = layout.value
        for batch in batches:
            ids = batch["vec_id"].to_numpy()
            for name, rows, raw in usable_rows(batch):
                cells = model.value.get(name)
                if cells is None:
                    continue
                x, ident = unit_rows(raw), ids[rows]
                for i, home, row, cell in C.probes(x, cells, min_similarity, z):
                    own, xs, raws = ident[i : i + len(home)], x[i : i + len(home)], raw[i : i + len(home)]
                    core = np.einsum("ij,ij->i", xs, cells.centres[home]) >= core_cos
                    block = C.block_of(own, cells.splits[home])
                    unit = cells.first_unit[home] + block
                    yield home_rows(tasks, cells, own, raws, home, unit, core)
                    # a pair is compared from its tighter cell: vectors there probe few cells
                    away = cell > home[row]
                    within = (cell == home[row]) & (cells.splits[cell] > 1) & ~core[row]
                    row, cell, to = C.expand_blocks(row[away | within], cell[away | within], cells)
                    # in its own cell a vector asks the blocks it isn't in
                    other = (cell != home[row]) | (to != unit[row])
                    row, to, lists = C.lists_by_unit(row[other], to[other], cell[other])
                    if len(row):
                        yield routed(tasks, tasks.asked(to, own[row]), 1, cells.number, own[row], lists, raws[row])

    return route


def _linker(model, layout, min_similarity: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_number = {c.number: c for c in model.value.values()}
        unit, block = None, None
        for u, number, side, rows in C.by_unit(batches):
            if u != unit:
                if block:
                    yield from block.finish()
                unit, block = u, LinkBlock(by_number[number], min_similarity, bool(layout.value.primary[u]))
            raw = from_binary(rows["vec"], block.cells.dims)
            ident, lists = rows["vec_id"].to_numpy(), rows["cells"]
            at = lists.offsets.to_numpy()
            if side == 0:
                block.add(ident, lists.values.to_numpy()[at[:-1]], rows["mark"].to_numpy().astype(bool), raw)
            else:
                block.ask(ident, raw, lists.values.to_numpy()[at[0] : at[-1]], at - at[0])
        if block:
            yield from block.finish()

    return link


def fit_leaves(vectors: DataFrame) -> dict[str, C.Cells]:
    return C.fit_cells(vectors, min_cosine=COMPACT, rows_per_cell=ROWS_PER_LEAF, unit_rows=UNIT_ROWS)


def linked_groups(vectors: DataFrame, min_similarity: float, min_size: int, z: float = Z) -> DataFrame:
    """(first_vec_id, vec_id) of every member but the first of the groups of at least ``min_size`` vectors.

    Two usable vectors of one index are linked if their cosine is at least
    ``min_similarity``; a group holds all that links connect.  vec_ids are
    unique over all indexes and lie within 62 bits.  Equal vectors are
    linked; no rows give no groups.
    """
    spark = vectors.sparkSession
    model = fit_leaves(vectors)
    if not model:
        return spark.createDataFrame([], "first_vec_id long, vec_id long")
    shared, single = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(C.lay_out(model, {}, PART_BYTES))
    layout = C.lay_out(model, C.unit_loads(C.load_share(vectors).mapInArrow(_router(shared, single, min_similarity, z), C.ROUTED)), PART_BYTES)
    tasks = spark.sparkContext.broadcast(layout)
    sent = C.at_units(vectors.mapInArrow(_router(shared, tasks, min_similarity, z), C.ROUTED), layout)
    found = checkpointed(sent.mapInArrow(_linker(shared, tasks, min_similarity), "kind int, a long, b long"))
    labels = found.filter(f"kind = {_LABEL}").unionByName(found.filter(f"kind = {_SELF}").distinct()).select(F.col("a").alias("node"), F.col("b").alias("label"))
    links = found.filter(f"kind = {_LINK}").select("a", "b")
    # a link joins the label that its asking vector has at home with the label it found
    own = links.join(labels, links["a"] == labels["node"], "left").select("a", F.coalesce("label", "a").alias("u"), F.col("b").alias("v"), F.col("label").isNull().alias("alone"))
    own = checkpointed(own.distinct())
    component = connected_components(own.select("u", "v"))
    nodes = labels.unionByName(own.filter("alone and a % 2 = 0").select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
    member = checkpointed(
        nodes.join(component, nodes["label"] == component["node"], "left").select(
            F.shiftright(nodes["node"], 1).alias("vec_id"), F.coalesce("root", "label").alias("group")
        )
    )
    groups = member.groupBy("group").agg(F.min("vec_id").alias("first_vec_id"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size)
    return member.join(groups, "group").filter("vec_id <> first_vec_id").select("first_vec_id", "vec_id")


_NODE = "index_name string, node long, vec_id long, similarity double, vec binary"
_LEAF = "index_name string, leaf long, vec_id long, similarity double"


def _at_nodes(name: str, ids: np.ndarray, raw: np.ndarray, base: int, centres: np.ndarray) -> pa.RecordBatch:
    """The rows at the nearest of the nodes numbered from ``base``."""
    x = unit_rows(raw)
    node = C.nearest(x, centres)
    cos = np.einsum("ij,ij->i", x.astype(np.float64), centres[node].astype(np.float64))
    return pa.record_batch([pa.array([name] * len(ids)), pa.array(base + node), pa.array(ids), pa.array(cos), as_binary(raw)], names=["index_name", "node", "vec_id", "similarity", "vec"])


def _refine(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """All rows of a node at its compact leaves."""
    rows = rows.sort_by("vec_id").combine_chunks()
    vec = rows["vec"].combine_chunks()
    x = unit_rows(from_binary(vec, len(vec[0].as_py()) // 4))
    own, centres = compact_leaves(x, COMPACT)
    cos = np.einsum("ij,ij->i", x.astype(np.float64), centres[own].astype(np.float64))
    return pa.table({"index_name": rows["index_name"], "leaf": (key[1].as_py() << _LEAF_BITS) + own, "vec_id": rows["vec_id"], "similarity": cos})


def _split_wide(at: DataFrame, turn: int) -> dict[tuple[str, int], np.ndarray]:
    """Centres for every node of ``at``, fitted on a sample of which half are rows outside ``COMPACT``, where there are so many."""
    near = F.col("similarity") >= COMPACT
    half = F.least(F.lit(C.SAMPLE_ROWS), F.floor(F.lit(C.SAMPLE_BYTES) / F.octet_length("vec"))) / 2
    share = half / F.when(near, F.col("n") - F.col("far")).otherwise(F.col("far"))
    sample = at.filter(F.pmod(F.xxhash64("vec_id", F.lit(turn)), F.lit(1 << 30)) < share * (1 << 30))

    def fit(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id").combine_chunks()
        vec = rows["vec"].combine_chunks()
        x = unit_rows(from_binary(vec, len(vec[0].as_py()) // 4))
        wanted = int(min(PASS_NODES, max(2, -(-2 * rows["n"][0].as_py() // rows["most"][0].as_py()))))
        centres = bisecting(x, wanted, 1, COMPACT)
        if len(centres) < 2:
            centres = bisecting(x, 2, 1)
        return pa.table({"index_name": [key[0].as_py()], "node": [key[1].as_py()], "dims": [x.shape[1]], "centres": [centres.tobytes()]})

    fitted = sample.groupBy("index_name", "node").applyInArrow(fit, "index_name string, node long, dims long, centres binary").collect()
    return {(r["index_name"], r["node"]): np.frombuffer(r["centres"], np.float32).reshape(-1, r["dims"]) for r in fitted}


def leaf_members(vectors: DataFrame, model: dict[str, C.Cells] | None = None) -> DataFrame:
    """(index_name, leaf, vec_id, similarity) of every usable vector: its leaf and its cosine to the leaf's centre, at least ``COMPACT``.

    A node of the first levels whose rows all lie within ``COMPACT`` is a
    leaf.  Any other is split further in a task that holds all its rows; one
    too large for a task is first split by passes over all its rows.
    """
    spark = vectors.sparkSession
    model = fit_leaves(vectors) if model is None else model
    if not model:
        return spark.createDataFrame([], _LEAF)
    shared = spark.sparkContext.broadcast(model)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["vec_id"].to_numpy()
            for name, rows, raw in usable_rows(batch):
                cells = shared.value.get(name)
                if cells is not None:
                    yield _at_nodes(name, ids[rows], raw, 0, cells.centres)

    def assign_again(nodes):
        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, at = np.array(batch["index_name"].to_pylist(), object), batch["node"].to_numpy()
                for name, node in sorted(set(zip(names.tolist(), at.tolist(), strict=True))):
                    base, centres = nodes.value[name, node]
                    rows = np.flatnonzero((names == name) & (at == node))
                    raw = from_binary(batch["vec"].take(pa.array(rows)), centres.shape[1])
                    yield _at_nodes(name, batch["vec_id"].to_numpy()[rows], raw, base, centres)

        return assign

    free = {name: len(c.centres) for name, c in model.items()}
    placed, out, turn = vectors.mapInArrow(assign, _NODE), [], 0
    while placed is not None:
        placed = checkpointed(placed)
        most = F.greatest(F.lit(1), F.least(F.lit(UNIT_ROWS), F.floor(F.lit(C.UNIT_BYTES) / F.max(F.octet_length("vec")))))
        nodes = placed.groupBy("index_name", "node").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("similarity") < COMPACT).alias("far"), most.alias("most"))
        nodes = checkpointed(nodes)
        at = placed.join(F.broadcast(nodes), ["index_name", "node"])
        out.append(at.filter("far = 0").select("index_name", F.shiftleft("node", _LEAF_BITS).alias("leaf"), "vec_id", "similarity"))
        out.append(at.filter("far > 0 and n <= most").select(*placed.columns).groupBy("index_name", "node").applyInArrow(_refine, _LEAF))
        wide, placed = "far > 0 and n > most", None
        if not nodes.filter(wide).isEmpty():
            split = _split_wide(at.filter(wide), turn)
            further = {}
            for (name, node), centres in sorted(split.items()):
                further[name, node] = free[name], centres
                free[name] += len(centres)
            placed = at.filter(wide).select("index_name", "node", "vec_id", "similarity", "vec").mapInArrow(assign_again(spark.sparkContext.broadcast(further)), _NODE)
            turn += 1
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def describe_leaves(members: DataFrame, typical: int) -> DataFrame:
    """(index_name, leaf, size, rank, vec_id, similarity): every leaf's size and its ``typical`` members nearest to the centre.

    Of equal similarities the smaller vec_id goes first.
    """
    members = checkpointed(members)
    near = Window.partitionBy("index_name", "leaf").orderBy(F.desc("similarity"), "vec_id")
    best = members.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= typical)
    sizes = members.groupBy("index_name", "leaf").agg(F.count(F.lit(1)).alias("size"))
    return best.join(sizes, ["index_name", "leaf"]).select("index_name", "leaf", "size", "rank", "vec_id", "similarity")
