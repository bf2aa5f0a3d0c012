"""A varied subset by tournament-pivoted rank-revealing QR.

The vectors are lifted to random Fourier features of a Gaussian kernel, so
that near vectors have nearly dependent rows and any number of distinct
directions can be picked from vectors of small width.  In every round each
partition deflates its rows by the picks so far, nominates a block of them by
column-pivoted QR (largest residual first), and pairs of nominations are
pivoted again up a tree until one block is left.  Rounds repeat until k rows
are picked, or until no row has a residual worth picking.

Large subsets are picked by region: an index is cut into the leaves of a
bisecting tree, about one for ``REGION_PICKS`` picks.  Vectors of different
regions are nearly independent under the kernel, so each region runs its own
rounds against its own picks until its residuals fall below the k-th largest
of the whole index; what is broadcast and factored for a row stays the same
however large k is.

A large group of similar rows spans few directions: once one of it is picked
the others have hardly any residual.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import checkpointed
from . import cells as C
from .bisect import unit_rows
from .vectors import as_binary, from_binary, usable_rows

#: Picks of one round, picks for each region, width of the feature space a pick needs, and the kernel's width (as distance between unit vectors).
BLOCK = 64
REGION_PICKS = 256
FEATURES_PER_PICK = 2
BANDWIDTH = 0.8
#: Squared residual (of 1) under which a row counts as dependent on the picks.
DEPENDENT = 1e-4
#: Rows that a task nominates from, and sampled rows for each region that the tree is fitted on.
UNIT_ROWS = 32_768
SAMPLED = 64
#: Nodes of the tournament's tree that one shuffle brings together, as a power of two.
LEVELS = 3
#: Bytes of the vectors of all picks, which travel to every executor; larger subsets are refused.
PICK_BYTES = 64 << 20
_PLACED = "index_name string, unit long, region int, node int, vec_id long, vec binary"
_ROWS = "index_name string, region int, node int, vec_id long, residual double, vec binary"


def features(x: np.ndarray, width: int, bandwidth: float = BANDWIDTH, seed: int = 11) -> np.ndarray:
    """Random Fourier features of unit rows; rows of length 1, the same in every process."""
    rng = np.random.default_rng([seed, x.shape[1], width])
    w = rng.standard_normal((x.shape[1], width)).astype(np.float32) / bandwidth
    b = rng.uniform(0, 2 * np.pi, width).astype(np.float32)
    f = np.cos(x @ w + b)
    return (f / np.sqrt((f * f).sum(axis=1, keepdims=True))).astype(np.float32)


def deflate(f: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The parts of the rows outside the span of the orthonormal ``basis`` rows."""
    return f - (f @ basis.T) @ basis if len(basis) else f


def orthonormal(f: np.ndarray) -> np.ndarray:
    return np.linalg.qr(f.T.astype(np.float64))[0].T.astype(np.float32) if len(f) else f


def pivots(f: np.ndarray, ident: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``f`` in the order of pivoted QR, at most ``n``, and their squared residuals; of equal residuals the smaller ident goes first."""
    order = np.argsort(ident, kind="stable")
    f = f[order]
    left = np.einsum("ij,ij->i", f, f)
    picks, residuals = [], []
    q = np.zeros((min(n, len(f)), f.shape[1]), np.float32)
    for k in range(len(q)):
        # residuals that differ by rounding alone are equal
        shown = np.round(left, 5)
        p = int(shown.argmax())
        if shown[p] <= DEPENDENT:
            break
        picks.append(order[p])
        residuals.append(float(shown[p]))
        own = f[p]
        for _ in range(2):
            own = own - (q[:k] @ own) @ q[:k]
        q[k] = own / np.sqrt(own @ own)
        left = np.maximum(left - (f @ q[k]) ** 2, 0)
        left[p] = 0
    return np.array(picks, np.int64), np.array(residuals)


def _batch(name: str, region: int, node: int, ident: np.ndarray, residual: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
    n = len(ident)
    return pa.record_batch(
        [pa.array([name] * n, pa.string()), pa.array(np.full(n, region, np.int32)), pa.array(np.full(n, node, np.int32)), pa.array(ident, pa.int64()), pa.array(residual, pa.float64()), as_binary(raw)],
        names=["index_name", "region", "node", "vec_id", "residual", "vec"],
    )


def _distinct(ident: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of byte-identical rows the one of the smallest ident."""
    order = np.argsort(ident, kind="stable")
    void = np.ascontiguousarray(raw[order]).view(np.dtype((np.void, raw.shape[1] * 4))).ravel()
    first = order[np.unique(void, return_index=True)[1]]
    return ident[first], raw[first]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, np.ndarray, np.ndarray]]:
    """(index, region, node, idents, raw vectors) of rows sorted by these."""
    if not batch.num_rows:
        return
    name = batch["index_name"].dictionary_encode()
    code, region, node = name.indices.to_numpy(), batch["region"].to_numpy(), batch["node"].to_numpy()
    ids = batch["vec_id"].to_numpy()
    cut = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (region[1:] != region[:-1]) | (node[1:] != node[:-1])])
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(ids)).tolist(), strict=True):
        vec = batch["vec"].slice(a, b - a)
        yield name.dictionary[int(code[a])].as_py(), int(region[a]), int(node[a]), ids[a:b], from_binary(vec, len(vec[0].as_py()) // 4)


@dataclass
class _Region:
    """The picks of a region: idents, raw vectors, and residuals made to fall."""

    ids: list[int] = field(default_factory=list)
    residuals: list[float] = field(default_factory=list)
    raw: np.ndarray | None = None
    over: bool = False

    def add(self, ids: list[int], residuals: list[float], raw: np.ndarray) -> None:
        for i, r in zip(ids, residuals, strict=True):
            self.ids.append(i)
            self.residuals.append(min(r, self.residuals[-1]) if self.residuals else r)
        self.raw = raw if self.raw is None else np.vstack([self.raw, raw])


class _Judge:
    """Ranks rows of one region after another against that region's picks."""

    def __init__(self, known: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], wanted: dict[tuple[str, int], int], width: int, first: int):
        self.known, self.wanted, self.width, self.first = known, wanted, width, first
        self.at: tuple[str, int] | None = None

    def __call__(self, name: str, region: int, ident: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(idents, residuals, raw vectors) of the best rows."""
        if (name, region) != self.at:
            self.at = name, region
            self.taken, picked = self.known.get(self.at, (np.zeros(0, np.int64), np.zeros((0, raw.shape[1]), np.float32)))
            self.basis = orthonormal(features(unit_rows(picked), self.width)) if len(picked) else np.zeros((0, self.width), np.float32)
        free = ~np.isin(ident, self.taken)
        ident, raw = _distinct(ident[free], raw[free])
        if not len(ident):
            return ident, np.zeros(0), raw
        best, left = pivots(deflate(features(unit_rows(raw), self.width), self.basis), ident, self.wanted.get((name, region), self.first))
        return ident[best], left, raw[best]


@dataclass
class Subset:
    """A varied subset: the usable rows where they lie, and the regions' picks with their numbers by (index, region)."""

    placed: DataFrame | None
    numbers: dict[tuple[str, int], list[int]]
    regions: dict[tuple[str, int], _Region]
    short: dict[str, tuple[int, int]]


def _tournament(placed: DataFrame, nodes: int, known, wanted, width: int, first: int, over: set) -> DataFrame:
    """One round: the nominations of every region that isn't over, after all re-pivoting."""
    spark = placed.sparkSession
    shared = spark.sparkContext.broadcast((known, wanted, over))

    def nominate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, at, held = _Judge(*shared.value[:2], width, first), None, None
        for batch in batches:
            for name, region, node, ident, raw in _runs(batch):
                if (name, region) in shared.value[2]:
                    continue
                if (name, region, node) != at:
                    if held is not None and len(held[0]):
                        yield _batch(*at, *held)
                    at, held = (name, region, node), None
                if held is not None:
                    ident, raw = np.concatenate([held[0], ident]), np.vstack([held[2], raw])
                held = judge(name, region, ident, raw)
        if held is not None and len(held[0]):
            yield _batch(*at, *held)

    def play(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        name, region, node = (x.as_py() for x in key)
        judge = _Judge(*shared.value[:2], width, first)
        rows = rows.combine_chunks().sort_by([("child", "ascending"), ("residual", "descending"), ("vec_id", "ascending")])
        child, ids = rows["child"].to_numpy(), rows["vec_id"].to_numpy()
        vec = rows["vec"].combine_chunks()
        raw = from_binary(vec, len(vec[0].as_py()) // 4)
        cut = np.flatnonzero(np.r_[True, child[1:] != child[:-1]])
        side = [(ids[a:b], rows["residual"].to_numpy()[a:b], raw[a:b]) for a, b in zip(cut, np.append(cut[1:], len(ids)), strict=True)]
        while len(side) > 1:
            pairs = [side[i : i + 2] for i in range(0, len(side), 2)]
            side = [judge(name, region, np.concatenate([p[0][0], p[1][0]]), np.vstack([p[0][2], p[1][2]])) if len(p) > 1 else p[0] for p in pairs]
        return pa.Table.from_batches([_batch(name, region, node, *side[0])])

    round_ = placed.select("index_name", "region", "node", "vec_id", "vec").mapInArrow(nominate, _ROWS)
    while nodes > 1:
        met = round_.withColumn("child", F.col("node")).withColumn("node", F.shiftright("node", LEVELS))
        round_ = met.groupBy("index_name", "region", "node").applyInArrow(play, _ROWS)
        nodes = -(-nodes >> LEVELS) if nodes > 1 << LEVELS else 1
    return round_


def select(vectors: DataFrame, k: int | None = None, share: float | None = None, block: int = BLOCK) -> Subset:
    """The picks of every index: ``k`` of them, or the ``share`` of its usable vectors, rounded up."""
    if (k is None) == (share is None) or (k is not None and k < 1) or (share is not None and not 0 < share <= 1):
        raise ValueError("either a positive k or a share above 0 and at most 1")
    picks_of = lambda n: k if share is None else math.ceil(share * n)
    model = C.fit_cells(
        vectors, unit_rows=UNIT_ROWS, cells_of=lambda n: -(-min(n, picks_of(n)) // REGION_PICKS), sample_rows=lambda n: max(1024, SAMPLED * -(-min(n, picks_of(n)) // REGION_PICKS))
    )
    if not model:
        return Subset(None, {}, {}, {})
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["vec_id"].to_numpy()
            for name, rows, raw in usable_rows(batch):
                cells, ident = shared.value[name], ids[rows]
                home = C.nearest(unit_rows(raw), cells.centres) if len(cells.centres) > 1 else np.zeros(len(rows), np.int64)
                node = C.block_of(ident, cells.splits[home])
                yield pa.record_batch(
                    [pa.array([name] * len(rows)), pa.array(cells.first_unit[home] + node), pa.array(home.astype(np.int32)), pa.array(node.astype(np.int32)), pa.array(ident), as_binary(raw)],
                    names=["index_name", "unit", "region", "node", "vec_id", "vec"],
                )

    placed = checkpointed(vectors.mapInArrow(place, _PLACED).repartition("unit").sortWithinPartitions("index_name", "region", "node"))
    usable = {r[0]: r[1] for r in placed.groupBy("index_name").count().collect()}
    want = {name: min(n, picks_of(n)) for name, n in usable.items()}
    if sum(n * 4 * model[name].dims for name, n in want.items()) > PICK_BYTES:
        raise ValueError(f"the vectors of a subset may take {PICK_BYTES} bytes")
    width = FEATURES_PER_PICK * min(max(want.values(), default=1), REGION_PICKS)
    nodes = max((int(c.splits.max()) for c in model.values()), default=1)
    regions: dict[tuple[str, int], _Region] = {}
    many = {name: len(model[name].centres) > 1 for name in want}
    asked = 0
    while True:
        wanted = {key: block if many[key[0]] else min(block, want[key[0]] - len(r.ids)) for key, r in regions.items() if not r.over}
        known = {key: (np.array(r.ids), r.raw) for key, r in regions.items() if not r.over}
        over = {key for key, r in regions.items() if r.over}
        got: dict[tuple[str, int], list] = {}
        for row in _tournament(placed, nodes, known, wanted, width, min(block, max(want.values(), default=1)), over).collect():
            got.setdefault((row["index_name"], row["region"]), []).append((row["residual"], row["vec_id"], np.frombuffer(row["vec"], np.float32)))
        asked += 1
        for key in {*got, *wanted}:
            new = sorted(got.get(key, []), key=lambda x: (-x[0], x[1]))
            most = wanted.get(key, block if many[key[0]] else min(block, want[key[0]]))
            region = regions.setdefault(key, _Region())
            if new := new[:most]:
                region.add([i for _, i, _ in new], [r for r, _, _ in new], np.vstack([v for _, _, v in new]))
            region.over = len(new) < most
        for name, n in want.items():
            own = [r for key, r in regions.items() if key[0] == name]
            all_ = sorted((x for r in own for x in r.residuals), reverse=True)
            if len(all_) >= n:
                # residuals fall, so what a region would pick further lies below its last one
                for r in own:
                    r.over = r.over or r.residuals[-1] <= all_[n - 1]
        if not got or all(r.over for r in regions.values()):
            break
    numbers: dict[tuple[str, int], list[int]] = {key: [] for key in regions}
    short = {}
    for name, n in want.items():
        order = sorted((-x, at, r.ids[at], key) for key, r in regions.items() if key[0] == name for at, x in enumerate(r.residuals))[:n]
        for number, (_, _, _, key) in enumerate(order, 1):
            numbers[key].append(number)
        if len(order) < n:
            short[name] = len(order), n - len(order)
    return Subset(placed, numbers, regions, short)


def _listed(subset: Subset) -> list[tuple[str, int, int]]:
    return [(key[0], number, ident) for key, own in subset.numbers.items() for number, ident in zip(own, subset.regions[key].ids, strict=False)]


def varied_subset(vectors: DataFrame, k: int | None = None, share: float | None = None, block: int = BLOCK) -> DataFrame:
    """(index_name, pick, vec_id): of every index ``k`` rows, or a ``share`` of its usable rows, in the order they were picked.

    ``vectors`` has (index_name, dims, vec_id, embedding).  Vectors that
    aren't usable are never picked.  Equal vectors and near copies of a pick
    come after all others, by vec_id; an index of fewer usable vectors than
    ``k`` gives all of them, an empty table none.  The picks' vectors, at most
    ``PICK_BYTES``, reach the driver and the executors; a larger subset is an
    error.
    """
    spark = vectors.sparkSession
    subset = select(vectors, k, share, block)
    schema = "index_name string, pick int, vec_id long"
    picked = spark.createDataFrame(_listed(subset), schema)
    if not subset.short:
        return picked
    lacking = spark.createDataFrame([(name, a, n) for name, (a, n) in subset.short.items()], "index_name string, have int, lacks int")
    rest = subset.placed.select("index_name", "vec_id").join(F.broadcast(lacking), "index_name").join(F.broadcast(picked.select("index_name", "vec_id")), ["index_name", "vec_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("index_name").orderBy("vec_id"))
    most = max(n for _, n in subset.short.values())
    fill = rest.withColumn("place", place).filter(F.col("place") <= most).filter("place <= lacks")
    return picked.unionByName(fill.select("index_name", (F.col("have") + F.col("place")).cast("int").alias("pick"), "vec_id"))


def represented(vectors: DataFrame, k: int | None = None, share: float | None = None, block: int = BLOCK) -> DataFrame:
    """(index_name, vec_id, pick, pick_vec_id, similarity) of every usable row: the pick of its region that is most similar to it.

    A pick represents itself.  With at most ``REGION_PICKS`` picks an index is
    one region.  Of equal similarities the earlier pick holds.
    """
    schema = "index_name string, vec_id long, pick int, pick_vec_id long, similarity double"
    subset = select(vectors, k, share, block)
    spark = vectors.sparkSession
    if subset.placed is None:
        return spark.createDataFrame([], schema)
    chosen = {key: (np.array(own, np.int32), np.array(subset.regions[key].ids[: len(own)]), unit_rows(subset.regions[key].raw[: len(own)])) for key, own in subset.numbers.items() if own}
    # at most PICK_BYTES
    shared = spark.sparkContext.broadcast(chosen)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, region, _, ident, raw in _runs(batch):
                number, ids, vectors_ = shared.value[name, region]
                x = unit_rows(raw)
                best = C.nearest(x, vectors_)
                itself = np.isin(ident, ids)
                if itself.any():
                    order = np.argsort(ids)
                    best[itself] = order[np.searchsorted(ids, ident[itself], sorter=order)]
                cosine = np.einsum("ij,ij->i", x.astype(np.float64), vectors_[best].astype(np.float64))
                yield pa.record_batch([pa.array([name] * len(ident)), pa.array(ident), pa.array(number[best]), pa.array(ids[best]), pa.array(cosine)], names=["index_name", "vec_id", "pick", "pick_vec_id", "similarity"])

    return subset.placed.select("index_name", "region", "node", "vec_id", "vec").mapInArrow(assign, schema)
