"""The k most similar vectors for every vector: cells, four-bit codes, exact reranking.

Within a unit the residuals of the vectors to their cell's centre are coded
with four bits for every two dimensions.  The code books are trained with a
score-aware loss that weighs the residual error parallel to the vector
``eta`` times the rest.  A scan adds up table entries for every code; the
score it gives is wrong by at most |q_perp| |err_perp| (parts orthogonal to
the centre; the parallel part of the error is stored and corrected).  Every
vector whose upper bound reaches both the least similarity asked for and the
k-th best so far is scored again exactly, in float64 from the raw vectors, so
scan and reranking lose nothing.  Only cells left out by the probing rule
(:func:`cells.probes`) could.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cells as C
from .bisect import unit_rows
from .vectors import as_binary, from_binary, usable_rows

TRAIN_ROWS = 8_192
#: Spreads (see cells.probes) within which a cell is probed.
Z = 3.0
#: Inner product from which errors matter, for the weight of parallel errors.
SCORE_THRESHOLD = 0.2
QUERY_BLOCK = 2_048
#: Bytes of probing rows of a task.
PART_BYTES = 8 << 20
#: Pairs scored at once, those of them whose table entries are added while they stay in the cache, and bytes of raw vectors gathered at once.
SCAN_PAIRS = 1 << 20
CACHED_PAIRS = 1 << 16
GATHER_BYTES = 16 << 20
#: Share of a block's pairs from which they are scored again as a block rather than one by one.
DENSE = 0.02
#: Decimals of a similarity; cosines that differ by rounding alone are equal.
DECIMALS = 12


def _padded(r: np.ndarray) -> np.ndarray:
    return r if r.shape[1] % 2 == 0 else np.hstack([r, np.zeros((len(r), 1), r.dtype)])


def eta(dims: int) -> float:
    """Weight of the parallel against the orthogonal residual error."""
    t = SCORE_THRESHOLD**2
    return max(1.0, (dims - 1) * t / (1 - t))


def encode(r: np.ndarray, u: np.ndarray, book: np.ndarray, weight: float, sweeps: int = 1) -> np.ndarray:
    """Codes (rows x pairs) of residuals ``r`` under the loss |e|^2 + (weight - 1) (u.e)^2, by coordinate descent."""
    pairs = book.shape[0]
    rs, us = r.reshape(len(r), pairs, 2), u.reshape(len(u), pairs, 2)
    codes = np.empty((len(r), pairs), np.uint8)
    plain = (book * book).sum(axis=2)
    for s in range(pairs):
        codes[:, s] = (plain[s] - 2 * rs[:, s] @ book[s].T).argmin(axis=1)
    if weight <= 1 or not len(r):
        return codes
    chosen = np.take_along_axis(book[None], codes[:, :, None, None].astype(np.int64), axis=2)[:, :, 0]
    along = ((rs - chosen) * us).sum(axis=2)
    total = along.sum(axis=1)
    for _ in range(sweeps):
        for s in range(pairs):
            e2 = (rs[:, s] ** 2).sum(axis=1)[:, None] + plain[s] - 2 * rs[:, s] @ book[s].T
            a = (rs[:, s] * us[:, s]).sum(axis=1)[:, None] - us[:, s] @ book[s].T
            rest = (total - along[:, s])[:, None]
            best = (e2 + (weight - 1) * (rest + a) ** 2).argmin(axis=1)
            codes[:, s] = best
            total += a[np.arange(len(r)), best] - along[:, s]
            along[:, s] = a[np.arange(len(r)), best]
    return codes


def decode(codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    out = np.empty((len(codes), book.shape[0], 2), np.float32)
    for s in range(book.shape[0]):
        out[:, s] = book[s][codes[:, s]]
    return out.reshape(len(codes), -1)


def train_book(x: np.ndarray, own: np.ndarray, rounds: int = 4) -> bytes:
    """Code book (pairs x 16 x 2) for directions of the residuals of unit rows ``x`` to their centres ``own``."""
    rng = np.random.default_rng(7)
    pick = rng.permutation(len(x))[:TRAIN_ROWS]
    x, own = x[pick], own[pick]
    r = _padded(x - own)
    n = np.sqrt((r * r).sum(axis=1))
    far = n > 1e-6
    if not far.any():
        return np.zeros((r.shape[1] // 2, 16, 2), np.float32).tobytes()
    r, u = r[far] / n[far, None], _padded(x)[far]
    pairs, weight = r.shape[1] // 2, eta(x.shape[1])
    rs = r.reshape(len(r), pairs, 2)
    book = rs[rng.integers(0, len(r), 16)].transpose(1, 0, 2).copy()
    for k in range(rounds):
        w = weight if k >= rounds // 2 else 1.0
        codes = encode(r, u, book, w)
        us = u.reshape(len(u), pairs, 2)
        along = ((rs - decode(codes, book).reshape(rs.shape)) * us).sum(axis=2)
        total = along.sum(axis=1)
        for s in range(pairs):
            # each code word solves (n I + (w-1) sum u u') c = sum (r + (w-1) u (rest + u.r))
            a = us[:, s]
            rhs = rs[:, s] + (w - 1) * a * ((total - along[:, s]) + (rs[:, s] * a).sum(axis=1))[:, None]
            k16 = codes[:, s]
            count = np.bincount(k16, minlength=16)
            m = np.zeros((16, 2, 2))
            b = np.stack([np.bincount(k16, rhs[:, j], 16) for j in (0, 1)], axis=1)
            for i in (0, 1):
                for j in (0, 1):
                    m[:, i, j] = (w - 1) * np.bincount(k16, a[:, i] * a[:, j], 16) + (i == j) * count
            m += np.eye(2) * 1e-9
            new = np.linalg.solve(m, b[:, :, None])[:, :, 0].astype(np.float32)
            book[s] = np.where(count[:, None] > 0, new, rs[rng.integers(0, len(r), 16), s])
    return book.astype(np.float32).tobytes()


class Block:
    """The vectors of a unit, coded, and the best matches of the queries that probe it."""

    def __init__(self, cells: C.Cells, k: int, min_similarity: float):
        self.cells, self.k, self.min = cells, k, min_similarity
        self.book = np.frombuffer(cells.extra, np.float32).reshape(-1, 16, 2)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ready = False

    def add(self, ident: np.ndarray, cell: np.ndarray, raw: np.ndarray) -> None:
        self.parts.append((ident, cell, raw))

    def _prepare(self) -> None:
        ident = np.concatenate([p[0] for p in self.parts])
        cell = np.concatenate([p[1] for p in self.parts])
        raw = np.vstack([p[2] for p in self.parts])
        # equal vectors are scored once; more than k of them are never needed
        void = np.ascontiguousarray(raw).view(np.dtype((np.void, raw.shape[1] * 4))).ravel()
        _, first, same = np.unique(void, return_index=True, return_inverse=True)
        order = np.lexsort((ident, same))
        place = np.arange(len(order)) - np.searchsorted(same[order], same[order])
        order = order[place < self.k]
        by_cell = np.argsort(cell[first], kind="stable")
        renumber = np.empty(len(first), np.int64)
        renumber[by_cell] = np.arange(len(first))
        group = renumber[same[order]]
        o2 = np.argsort(group, kind="stable")
        self.ids, group = ident[order][o2], group[o2]
        self.id_at = np.searchsorted(group, np.arange(len(first) + 1))
        first = first[by_cell]
        self.cell, self.raw = cell[first], raw[first].astype(np.float64)
        self.norm = np.sqrt((self.raw * self.raw).sum(axis=1))
        x = (self.raw / self.norm[:, None]).astype(np.float32)
        c = self.cells.centres[self.cell]
        r = _padded(x - c)
        self.scale = np.sqrt((r * r).sum(axis=1))
        unit = np.divide(r, self.scale[:, None], out=np.zeros_like(r), where=self.scale[:, None] > 1e-9)
        self.codes = encode(unit, _padded(x), self.book, eta(x.shape[1]))
        err = (r - decode(self.codes, self.book) * self.scale[:, None])[:, : x.shape[1]]
        self.along = (err * c).sum(axis=1)
        self.across = np.sqrt(np.maximum((err * err).sum(axis=1) - self.along**2, 0)) + 1e-6
        ids, starts = np.unique(self.cell, return_index=True)
        self.spans = dict(zip(ids.tolist(), zip(starts.tolist(), np.append(starts[1:], len(self.cell)).tolist(), strict=True), strict=True))
        self.ready = True

    def search(self, ident: np.ndarray, raw: np.ndarray, probed: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query id, vector id, similarity) of at most k for each query; ``probed[at[i]:at[i+1]]`` are the cells of query i."""
        if not self.parts:
            return
        if not self.ready:
            self._prepare()
        for i in range(0, len(ident), QUERY_BLOCK):
            j = min(len(ident), i + QUERY_BLOCK)
            q64 = raw[i:j].astype(np.float64)
            q64 /= np.sqrt((q64 * q64).sum(axis=1))[:, None]
            q = q64.astype(np.float32)
            qp = _padded(q)
            table = np.einsum("qsj,scj->scq", qp.reshape(len(q), -1, 2), self.book)
            least = np.full(len(q), self.min)
            found_q, found_e, found_s = [], [], []
            who = np.repeat(np.arange(len(q)), np.diff(at[i : j + 1]))
            what = probed[at[i] : at[j]]
            order = np.argsort(what, kind="stable")
            who, what = who[order], what[order]
            for c in np.unique(what):
                if c not in self.spans:
                    continue
                a, b = self.spans[c]
                here = who[np.searchsorted(what, c) : np.searchsorted(what, c, "right")]
                step = max(1, SCAN_PAIRS // (b - a))
                for k in range(0, len(here), step):
                    e, w, s = self._scan(int(c), a, b, here[k : k + step], q, q64, table, least)
                    found_e.append(e)
                    found_q.append(w)
                    found_s.append(s)
            if not found_q:
                continue
            w, e, s = np.concatenate(found_q), np.concatenate(found_e), np.concatenate(found_s)
            n = self.id_at[e + 1] - self.id_at[e]
            v = self.ids[np.repeat(self.id_at[e], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            w, s = np.repeat(w, n), np.repeat(s, n)
            order = np.lexsort((v, -s, w))
            w, v, s = w[order], v[order], s[order]
            keep = np.arange(len(w)) - np.searchsorted(w, w) < self.k
            yield ident[i:j][w[keep]], v[keep], s[keep]

    def _exact(self, e: np.ndarray, w: np.ndarray, q64: np.ndarray) -> np.ndarray:
        """Cosines of own rows and queries, pair by pair."""
        out = np.empty(len(e))
        step = max(1, GATHER_BYTES // (8 * q64.shape[1]))
        for i in range(0, len(e), step):
            j = slice(i, i + step)
            out[j] = np.einsum("ij,ij->i", self.raw[e[j]], q64[w[j]]) / self.norm[e[j]]
        return np.round(out, DECIMALS)

    def _scan(self, c: int, a: int, b: int, qs: np.ndarray, q: np.ndarray, q64: np.ndarray, table: np.ndarray, least: np.ndarray):
        qc = q[qs] @ self.cells.centres[c]
        own = np.ascontiguousarray(table[:, :, qs])
        score = np.empty((b - a, len(qs)), np.float32)
        block = max(1, CACHED_PAIRS // len(qs))
        part = np.empty((min(block, b - a), len(qs)), np.float32)
        for i in range(a, b, block):
            codes = self.codes[i : min(b, i + block)]
            to, more = score[i - a : i - a + len(codes)], part[: len(codes)]
            np.take(own[0], codes[:, 0], axis=0, out=to, mode="clip")
            for s in range(1, len(own)):
                np.take(own[s], codes[:, s], axis=0, out=more, mode="clip")
                to += more
        score *= self.scale[a:b, None]
        score += qc * (1 + self.along[a:b, None])
        slack = self.across[a:b, None] * np.sqrt(np.maximum(1 - qc * qc, 0)) + 1e-6
        if b - a > self.k:
            # the exact scores of the k best by code bound the k-th best from below
            best = np.argpartition(score, b - a - self.k, axis=0)[b - a - self.k :]
            sure = self._exact(a + best.ravel(), np.tile(qs, self.k), q64).reshape(self.k, -1).min(axis=0)
            least[qs] = np.maximum(least[qs], sure)
        score += slack
        e, w = np.nonzero(score >= least[qs] - 1e-6)
        if len(e) > DENSE * score.size:
            exact = np.round((self.raw[a:b] @ q64[qs].T)[e, w] / self.norm[a + e], DECIMALS)
        else:
            exact = self._exact(a + e, qs[w], q64)
        ok = np.flatnonzero(exact >= least[qs[w]] - 1e-12)
        # of each query what reaches its k-th best, ties included
        ok = ok[np.lexsort((-exact[ok], w[ok]))]
        e, w, exact = e[ok], w[ok], exact[ok]
        begin = np.searchsorted(w, w)
        kth = begin + self.k - 1
        full = (kth < len(w)) & (w[np.minimum(kth, len(w) - 1)] == w) if len(w) else np.zeros(0, bool)
        bar = np.where(full, exact[np.minimum(kth, len(w) - 1)], -1.0) if len(w) else exact
        np.maximum.at(least, qs[w], bar)
        keep = exact >= bar
        return a + e[keep], qs[w[keep]], exact[keep]


def _router(model, layout, k: int, min_similarity: float, z: float):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks = layout.value
        for batch in batches:
            ids, sides = batch["vec_id"].to_numpy(), batch["side"].to_numpy()
            for name, rows, raw in usable_rows(batch):
                cells = model.value.get(name)
                if cells is None:
                    continue
                x, ident, side = unit_rows(raw), ids[rows], sides[rows]
                own = np.flatnonzero(side == 0)
                if len(own):
                    home = C.nearest(x[own], cells.centres)
                    yield home_rows(tasks, cells, ident[own], raw[own], home, cells.first_unit[home] + C.block_of(ident[own], cells.splits[home]))
                ask = np.flatnonzero(side == 1)
                for i, _, row, cell in C.probes(x[ask], cells, min_similarity, z):
                    row, unit, lists = C.lists_by_unit(*(lambda r, c, u: (r, u, c))(*C.expand_blocks(row, cell, cells)))
                    rows_ = ask[i + row]
                    yield routed(tasks, tasks.asked(unit, ident[rows_]), 1, cells.number, ident[rows_], lists, raw[rows_])

    return route


def home_rows(tasks: C.Layout, cells: C.Cells, ident: np.ndarray, raw: np.ndarray, home: np.ndarray, unit: np.ndarray, mark: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows routed to all tasks of the units that they live in."""
    row, task = tasks.homes(unit)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32)), pa.array(home[row].astype(np.int32)))
    return routed(tasks, task, 0, cells.number, ident[row], lists, raw[row], None if mark is None else mark[row])


def routed(tasks: C.Layout, task: np.ndarray, side: int, number: int, ident, lists: pa.Array, raw: np.ndarray, mark=None) -> pa.RecordBatch:
    n = len(ident)
    mark = np.zeros(n, np.int32) if mark is None else mark.astype(np.int32)
    return pa.record_batch(
        [
            pa.array(tasks.partition[task].astype(np.int32)), pa.array(task, pa.int64()), pa.array(np.full(n, side, np.int32)), pa.array(np.full(n, number, np.int32)),
            pa.array(ident, pa.int64()), lists, pa.array(mark), as_binary(raw),
        ],
        schema=C.ROUTED_SCHEMA,
    )


def _searcher(model, k: int, min_similarity: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_number = {c.number: c for c in model.value.values()}
        unit, block = None, None
        for u, number, side, rows in C.by_unit(batches):
            if u != unit:
                unit, block = u, Block(by_number[number], k, min_similarity)
            raw = from_binary(rows["vec"], block.cells.dims)
            ident = rows["vec_id"].to_numpy()
            lists = rows["cells"]
            at = lists.offsets.to_numpy()
            if side == 0:
                block.add(ident, lists.values.to_numpy()[at[:-1]], raw)
                continue
            for q, v, s in block.search(ident, raw, lists.values.to_numpy()[at[0] : at[-1]], at - at[0]):
                yield pa.record_batch([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "similarity"])

    return search


def nearest_vectors(vectors: DataFrame, k: int, min_similarity: float, z: float = Z, rows_per_cell: int = C.ROWS_PER_CELL, unit_rows: int = C.UNIT_ROWS) -> DataFrame:
    """(query_id, vec_id, similarity): for each row of side 1 the at most k rows of side 0 of its index that are most similar.

    ``vectors`` has (index_name, dims, vec_id, side, embedding), see
    :func:`vectors.with_dimensions`.  Similarity is the cosine; only pairs of
    at least ``min_similarity`` (below 1) count, of equal similarities the
    smaller vec_id goes first, and vectors delivered several times count as
    vectors of their own.  Vectors that aren't usable take no part.
    ``rows_per_cell`` and ``unit_rows`` size the cells and the units of work.
    """
    model = C.fit_cells(vectors.filter("side = 0"), rows_per_cell=rows_per_cell, extra=train_book, unit_rows=unit_rows)
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, similarity double"
    if not model:
        return spark.createDataFrame([], schema)
    shared, single = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(C.lay_out(model, {}, PART_BYTES))
    share = C.load_share(vectors.filter("side = 1")).mapInArrow(_router(shared, single, k, min_similarity, z), C.ROUTED)
    layout = C.lay_out(model, C.unit_loads(share), PART_BYTES)
    routed_rows = vectors.mapInArrow(_router(shared, spark.sparkContext.broadcast(layout), k, min_similarity, z), C.ROUTED)
    found = C.at_units(routed_rows, layout).mapInArrow(_searcher(shared, k, min_similarity), schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= k).drop("_place")
