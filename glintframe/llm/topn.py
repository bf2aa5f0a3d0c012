"""Best N items of every group by merging sorted runs with a loser tree.

Every input partition is cut into runs ordered by (group, score descending,
rank, id).  Within a run only an item's first row of a group is kept, and no
more rows of a group than its N, or than a bound on the N of all but
``LARGE_GROUPS`` groups: rows beyond can't be among the result.  The runs are stored as packed blocks by bucket of the group, so
one shuffle brings the runs of a bucket, and the N of its groups, together.
There a loser tree merges them and, after N outputs of a group, seeks every
run to its next group.  A hot group reaches its bucket as at most N rows a
run, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_ROWS = 1 << 19
BUCKET_ROWS = 250_000
#: Decoded rows of a bucket that are held before they are merged into one run.
WAVE_ROWS = 4_000_000
#: Groups whose own N is sent to every executor, at most: those of the largest N.
LARGE_GROUPS = 100_000
_LAST = np.iinfo(np.int64).max


class Run:
    """Rows in order: group, score (highest first), rank, id, and the item as bytes."""

    __slots__ = ("group", "score", "rank", "ident", "starts", "items", "edges", "at", "g")

    def __init__(self, group, score, rank, ident, starts, items):
        self.group, self.score, self.rank, self.ident, self.starts, self.items = group, score, rank, ident, starts, items
        self.at = self.g = 0
        self.edges = np.append(np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)) if len(group) else np.zeros(1, np.int64)

    def item(self, i: int) -> bytes:
        return self.items[self.starts[i] : self.starts[i + 1]]

    def take(self, rows: np.ndarray) -> Run:
        size = np.diff(self.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        source = np.frombuffer(self.items, np.uint8)
        at = np.arange(starts[-1]) - np.repeat(starts[:-1], size) + np.repeat(self.starts[rows], size)
        return Run(self.group[rows], self.score[rows], self.rank[rows], self.ident[rows], starts, source[at].tobytes())

    def pack(self) -> bytes:
        head = np.array([len(self.group)], np.int64)
        return b"".join([head.tobytes(), *(np.ascontiguousarray(x).tobytes() for x in (self.group, self.ident, self.starts, self.rank, self.score)), self.items])

    @classmethod
    def unpack(cls, b: bytes) -> Run:
        n = int(np.frombuffer(b, np.int64, 1)[0])
        at, out = 8, []
        for kind, k in ((np.int64, n), (np.int64, n), (np.int64, n + 1), (np.int64, n), (np.float32, n)):
            out.append(np.frombuffer(b, kind, k, at))
            at += k * np.dtype(kind).itemsize
        group, ident, starts, rank, score = out
        return cls(group, score, rank, ident, starts, b[at:])

    def head(self):
        i = self.at
        return (self.group[i], -self.score[i], self.rank[i], self.ident[i]) if i < len(self.group) else None

    def seek(self) -> None:
        """To the first row of the next group."""
        self.g += 1
        self.at = int(self.edges[self.g])

    def step(self) -> None:
        self.at += 1
        if self.at == self.edges[self.g + 1]:
            self.g += 1


class LoserTree:
    """Tournament over runs: each inner node keeps the loser, the root the run with the least head; None is greater than all."""

    def __init__(self, runs: list[Run]):
        self.runs, n = runs, 1
        while n < len(runs):
            n *= 2
        self.leaves = n
        self.heads = [r.head() for r in runs] + [None] * (n - len(runs))
        self.lost = [0] * n
        won = [0] * n + list(range(n))
        for k in range(n - 1, 0, -1):
            a, b = won[2 * k], won[2 * k + 1]
            won[k], self.lost[k] = (a, b) if self._less(a, b) else (b, a)
        self.winner = won[1] if n > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def replay(self) -> None:
        """After the winner's run has moved."""
        w = self.winner
        self.heads[w] = self.runs[w].head()
        k = (w + self.leaves) // 2
        while k:
            if self._less(self.lost[k], w):
                w, self.lost[k] = self.lost[k], w
            k //= 2
        self.winner = w

    def runner_up(self):
        """The least head of the other runs: the least among those that lost to the winner."""
        best, k = None, (self.winner + self.leaves) // 2
        while k:
            h = self.heads[self.lost[k]]
            if h is not None and (best is None or h < best):
                best = h
            k //= 2
        return best


def merge_runs(runs: list[Run], limit) -> Iterator[tuple[int, np.ndarray]]:
    """(run, rows of it) in merged order: of each group the first ``limit(group)`` rows with different items."""
    runs_ = [r for r in runs if len(r.group)]
    if not runs_:
        return
    index = {id(r): k for k, r in enumerate(runs)}
    tree = LoserTree(runs_)
    while (h := tree.heads[tree.winner]) is not None:
        group, run = h[0], runs_[tree.winner]
        n = limit(group)
        second = tree.runner_up()
        if second is None or second[0] != group:
            end = int(run.edges[run.g + 1])
            if n > 0:
                yield index[id(run)], np.arange(run.at, min(end, run.at + n))
            run.seek()
            tree.replay()
            continue
        seen: set[bytes] = set()
        while len(seen) < n and h is not None and h[0] == group:
            run = runs_[tree.winner]
            item = run.item(run.at)
            if item not in seen:
                seen.add(item)
                yield index[id(run)], np.array([run.at])
            run.step()
            tree.replay()
            h = tree.heads[tree.winner]
        while h is not None and h[0] == group:
            runs_[tree.winner].seek()
            tree.replay()
            h = tree.heads[tree.winner]


class Bound:
    """How many rows of a group a run keeps: ``most``, and more for the groups that are named."""

    def __init__(self, most: int, groups: np.ndarray, limits: np.ndarray):
        order = np.argsort(groups)
        self.most, self.groups, self.limits = most, groups[order], limits[order]

    def of(self, groups: np.ndarray) -> np.ndarray:
        out = np.full(len(groups), self.most, np.int64)
        if len(self.groups):
            at = np.minimum(np.searchsorted(self.groups, groups), len(self.groups) - 1)
            named = self.groups[at] == groups
            out[named] = self.limits[at[named]]
        return out


ALL = Bound(int(_LAST), np.zeros(0, np.int64), np.zeros(0, np.int64))


def bound_of(asked: DataFrame) -> Bound:
    """The bound for limits (g, n): the least power of two that all but ``LARGE_GROUPS`` keep to, and the groups above it."""
    power = F.greatest(F.lit(0), F.ceil(F.log2("n"))).cast("int")
    counts = sorted((r["power"], r["count"]) for r in asked.groupBy(power.alias("power")).count().collect())
    above, most = 0, 1 << counts[-1][0] if counts else 0
    for k in range(len(counts) - 1, -1, -1):
        above += counts[k][1]
        if above > LARGE_GROUPS:
            break
        most = 1 << counts[k - 1][0] if k else 0
    large = asked.filter(F.col("n") > most).collect()
    return Bound(most, np.array([r["g"] for r in large], np.int64), np.array([r["n"] for r in large], np.int64))


def build_run(table: pa.Table, most: Bound) -> Run:
    """One run of a table (g, score, rank, id, item): first rows of each (group, item), and of a group no more than its bound."""
    item = table["item"].combine_chunks()
    g, score, rank, ident = (table[c].to_numpy() for c in ("g", "score", "rank", "id"))
    order = np.lexsort((ident, rank, -score, g))
    codes = pc.dictionary_encode(item).indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]
    groups = np.cumsum(np.r_[False, g[order][1:] != g[order][:-1]]) if len(order) else codes
    _, first = np.unique(groups * (codes.max(initial=0) + 1) + codes, return_index=True)
    first.sort()
    own = groups[first]
    place = np.arange(len(first)) - np.searchsorted(own, own)
    rows = order[first[place < most.of(g[order][first])]]
    item = item.take(pa.array(rows)).cast(pa.binary()).cast(pa.large_binary())
    starts = np.frombuffer(item.buffers()[1], np.int64, len(item) + 1, item.offset * 8) if len(item) else np.zeros(1, np.int64)
    data = item.buffers()[2].to_pybytes()[starts[0] : starts[-1]] if len(item) and item.buffers()[2] else b""
    return Run(g[rows], score[rows].astype(np.float32), rank[rows], ident[rows], starts - starts[0], data)


def _bucket(g: np.ndarray, buckets: int) -> np.ndarray:
    return ((g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, x = zip(*rows, strict=True)
    return pa.record_batch([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], schema=_PACKED)


def _run_writer(buckets: int, most: Broadcast):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush():
            run = build_run(pa.Table.from_batches(held), most.value)
            to = _bucket(run.group, buckets)
            for b in np.unique(to):
                yield _packed([(int(b), 1, run.take(np.flatnonzero(to == b)).pack())])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RUN_ROWS:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    return write


def _limit_writer(buckets: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, n = batch["g"].to_numpy(), batch["n"].to_numpy()
            to = _bucket(g, buckets)
            out = [(int(b), 0, np.stack([g[to == b], n[to == b]]).tobytes()) for b in np.unique(to)]
            if out:
                yield _packed(out)

    return write


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by (bucket, kind): the limits of a bucket first, then its runs."""
    limits: list[np.ndarray] = []
    runs: list[Run] = []
    held = 0
    bucket = None

    def limiter():
        ln = np.hstack(limits) if limits else np.zeros((2, 0), np.int64)
        known = dict(zip(ln[0].tolist(), ln[1].tolist(), strict=True))
        return lambda g: known.get(int(g), 0)

    def collapse() -> Run:
        """The held runs as one; all that may still be among the first N stays."""
        parts = list(merge_runs(runs, limiter()))
        taken = [runs[k].take(rows) for k, rows in parts] if len(parts) < 1000 else None
        if taken is None:
            pieces: dict[int, list[np.ndarray]] = {}
            for k, rows in parts:
                pieces.setdefault(k, []).append(rows)
            taken = [runs[k].take(np.concatenate(v)) for k, v in pieces.items()]
        whole = pa.table(
            {
                "g": np.concatenate([r.group for r in taken] or [np.zeros(0, np.int64)]),
                "score": np.concatenate([r.score for r in taken] or [np.zeros(0, np.float32)]),
                "rank": np.concatenate([r.rank for r in taken] or [np.zeros(0, np.int64)]),
                "id": np.concatenate([r.ident for r in taken] or [np.zeros(0, np.int64)]),
                "item": pa.array([r.item(i) for r in taken for i in range(len(r.group))], pa.binary()),
            }
        )
        return build_run(whole, ALL)

    def finish() -> Iterator[pa.RecordBatch]:
        ids = [runs[k].ident[rows] for k, rows in merge_runs(runs, limiter())]
        if ids:
            yield pa.record_batch([pa.array(np.concatenate(ids))], names=["id"])

    for batch in batches:
        for b, kind, block in zip(batch["bucket"].to_pylist(), batch["kind"].to_pylist(), batch["block"], strict=True):
            if b != bucket:
                if bucket is not None:
                    yield from finish()
                limits, runs, held, bucket = [], [], 0, b
            raw = block.as_py()
            if kind == 0:
                limits.append(np.frombuffer(raw, np.int64).reshape(2, -1))
                continue
            runs.append(Run.unpack(raw))
            held += len(runs[-1].group)
            if held > WAVE_ROWS and len(runs) > 1:
                runs = [collapse()]
                held = len(runs[0].group)
    if bucket is not None:
        yield from finish()


def sortable(c: Column) -> Column:
    """An unsigned 64-bit DECIMAL(20,0) as a LONG of the same order."""
    return (c - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")


def top_n_per_group(rows: DataFrame, limits: DataFrame, group: str, item: str, score: str, rank: str, ident: str, n: str) -> DataFrame:
    """(ident) of the best rows of every group.

    ``limits`` has (group, n); several rows of a group mean the largest n, a
    null or non-positive n means no result, as does a group without a row
    there.  Rows with a null group, item or ident, or a null or NaN score take
    no part.  A group's rows are ordered by score (highest first; 0 and -0 are
    equal), rank (lowest first, null last), ident; an item takes part with its
    first row alone; the first n rows that remain are the result.  Groups are
    DECIMAL(20,0) in the unsigned 64-bit range; scores float, ranks int,
    idents long, items string.
    """
    asked = limits.filter(F.col(group).isNotNull() & (F.col(n) > 0)).groupBy(sortable(F.col(group)).alias("g")).agg(F.max(F.col(n).cast("long")).alias("n"))
    most = rows.sparkSession.sparkContext.broadcast(bound_of(asked))
    # the count comes from the files' footers
    buckets = max(8, -(-rows.count() // BUCKET_ROWS))
    used = rows.filter(F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(ident).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)).select(
        sortable(F.col(group)).alias("g"),
        (F.col(score) + F.lit(0.0).cast("float")).alias("score"),
        F.coalesce(F.col(rank).cast("long"), F.lit(int(_LAST))).alias("rank"),
        F.col(ident).cast("long").alias("id"),
        F.col(item).cast("string").alias("item"),
    )
    schema = "bucket int, kind int, block binary"
    blocks = used.mapInArrow(_run_writer(buckets, most), schema).unionByName(asked.mapInArrow(_limit_writer(buckets), schema))
    return blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_merger, "id long").select(F.col("id").alias(ident))
