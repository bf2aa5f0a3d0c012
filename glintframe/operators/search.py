"""Exact grouped maximum-inner-product search for batches of queries.

The query vectors of a call are sent to the executors in blocks of at most
``QUERY_BLOCK``.  Each partition scores its rows by matrix products in
float32, whose error bound tells which rows may be among the best; those are
scored again in float64, and no more than k groups of a query are passed on: a
group among the k best of all is among the k best of the partition that holds
its best row.  The best of a sample bound what many queries pass on.  Without
negative vectors the index is never moved.  With them, it is written once with
the rows of every group side by side, so that a partition knows which of its
groups the exclusion threshold drops; the thresholds are found before, once
for each distinct negative vector, from one score a group.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import checkpointed

#: Query vectors that are sent to the executors at once, and their bytes.
QUERY_BLOCK = 16_384
QUERY_BYTES = 64 << 20
#: Blocks that stay in the plan; the answers of further ones are written to the checkpoint folder one by one.
OPEN_BLOCKS = 4
#: Decimals of a score that count in orders; equal ones are ordered by key.
DECIMALS = 9
#: Queries from which on a sample of the groups, one in SAMPLE, is searched first.
SAMPLED_QUERIES, SAMPLE = 1_024, 8
#: Rows that are scored at once, at first and at most, and queries.
FIRST_ROWS, ROWS, QUERIES = 64, 2_048, 1_024
#: Candidates of a partition that are held before they are cut to the best, and passed on if all of them are among these.
PENDING, HELD = 1 << 18, 1 << 21


def _matrix(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the wanted width and their vectors; null elements become NaN."""
    sizes = np.diff(col.offsets.to_numpy())
    rows = np.flatnonzero((sizes == width) & col.is_valid().to_numpy(zero_copy_only=False))
    values = col.values.to_numpy(zero_copy_only=False)
    return rows, values[col.offsets.to_numpy()[:-1][rows][:, None] + np.arange(width)]


def _chunks(batches: Iterator[pa.RecordBatch], width: int, first: int, most: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys and vectors of the rows of the wanted width: ``first`` of them, then twice as many each time, up to ``most``."""
    for batch in batches:
        rows, m = _matrix(batch["vector"], width)
        keys = batch["key"].take(pa.array(rows))
        i = 0
        while i < len(rows):
            yield keys.slice(i, first), m[i : i + first]
            i, first = i + first, min(2 * first, most)


def _rows_for(vectors: int) -> int:
    """Rows whose scores against so many vectors take 32 MB."""
    return int(np.clip((4 << 20) // max(1, vectors), 1, ROWS))


def _best_by_run(keys: pa.Array, m: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of every row's run of equal keys, and every run's best inner product with each of ``others``: NaN ignored, -inf without any."""
    codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    s = m.astype(np.float64) @ others.T
    s[np.isnan(s)] = -np.inf
    return codes, np.round(np.maximum.reduceat(s, np.flatnonzero(np.diff(codes, prepend=-1)), axis=0), DECIMALS)


class _Asked(NamedTuple):
    """A block of queries, ready to be sent: ``against`` is the number of a query's negative vector, and the last threshold, NaN, that of queries without one."""

    ids: np.ndarray
    vectors: np.ndarray
    k: np.ndarray
    floor: np.ndarray
    against: np.ndarray
    negatives: np.ndarray
    thresholds: np.ndarray


class _Lists:
    """The best groups of every query among those added so far."""

    def __init__(self, asked: _Asked):
        self.asked, self.bound = asked, asked.floor.copy()
        self.codes: dict[str, int] = {}
        self.kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        self.pending = 0

    def add(self, q: np.ndarray, keys: pa.Array, row: np.ndarray, score: np.ndarray) -> None:
        """Query numbers with scores of the groups whose keys stand in the places ``row``."""
        if not len(q):
            return
        used, place = np.unique(row, return_inverse=True)
        codes = np.array([self.codes.setdefault(x, len(self.codes)) for x in keys.take(pa.array(used)).to_pylist()])
        self.kept.append((q, codes[place], score))
        self.pending += len(q)
        if self.pending > max(PENDING, len(self.kept[0][0])):
            self.settle()

    def settle(self) -> None:
        """Leaves the k best groups of every query, each once; the last of k is the bound for rows to come."""
        q, code, score = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        names = sorted(self.codes)
        place = np.empty(len(names), np.int64)
        place[[self.codes[x] for x in names]] = np.arange(len(names))
        at = place[code] if len(names) else code
        order = np.lexsort((-score, at, q))
        q, at, score = q[order], at[order], score[order]
        once = np.ones(len(q), bool)
        once[1:] = (np.diff(q) != 0) | (np.diff(at) != 0)
        q, at, score = q[once], at[once], score[once]
        order = np.lexsort((at, -score, q))
        q, at, score = q[order], at[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
        last = rank == self.asked.k[q]
        self.bound[q[last]] = np.maximum(self.bound[q[last]], score[last])
        best = rank <= self.asked.k[q]
        used, code = np.unique(at[best], return_inverse=True)
        self.codes = {names[u]: i for i, u in enumerate(used)}
        self.kept, self.pending = [(q[best], code, score[best])], 0

    def taken(self, most: int = -1) -> Iterator[pa.RecordBatch]:
        """The best groups (query_id, k, key, score), if they were more than ``most`` when last cut; they are held no longer, but their bounds stay."""
        if len(self.kept[0][0]) <= most:
            return
        self.settle()
        q, code, score = self.kept[0]
        names = pa.array(list(self.codes), pa.string())
        for i in range(0, len(q), 1 << 16):
            own = q[i : i + (1 << 16)]
            yield pa.record_batch([pa.array(self.asked.ids[own]), pa.array(self.asked.k[own]), names.take(pa.array(code[i : i + (1 << 16)])), pa.array(score[i : i + (1 << 16)])], names=["query_id", "k", "key", "score"])
        self.codes, self.kept = {}, [(q[:0], code[:0], score[:0])]


def _hits(m: np.ndarray, asked: _Asked, narrow: np.ndarray, lengths: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, query numbers and scores in float64 of all pairs that reach the query's bound."""
    wide = m.astype(np.float64)
    norms = np.sqrt((wide * wide).sum(axis=1))
    # rows that aren't finite, or very long, have no error bound in float32
    for rows, usual in ((np.flatnonzero(norms < 1e15), True), (np.flatnonzero(~(norms < 1e15)), False)):
        if not len(rows):
            continue
        short, long, longest = m[rows], wide[rows], norms[rows].max()
        for j in range(0, len(lengths), QUERIES):
            own = slice(j, j + QUERIES)
            cut = bound[own] - 1e-9 - 1e-14 * np.abs(np.where(np.isinf(bound[own]), 0, bound[own]))
            if usual and lengths[own].max() < 1e15:
                # rounding of the query, the products and their sums, and what is too small for a float32
                cut = np.nextafter((cut - (m.shape[1] + 4) * 2.0**-24 * 1.01 * longest * lengths[own] - 1e-30).astype(np.float32), np.float32(-np.inf))
                s = short @ narrow[own].T
            else:
                s = long @ asked.vectors[own].T
                s[np.isnan(s)] = -np.inf
            found = np.flatnonzero(s >= cut)
            for i in range(0, len(found), 1 << 14):
                row, q = np.divmod(found[i : i + (1 << 14)], s.shape[1])
                q += j
                score = np.einsum("ij,ij->i", long[row], asked.vectors[q])
                score = np.round(np.where(np.isnan(score), -np.inf, score), DECIMALS)
                good = score >= bound[q]
                yield rows[row[good]], q[good], score[good]


def _searcher(shared: Broadcast[_Asked]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (key, vector) to a partition's best groups; where queries have negative vectors, a group's rows stand side by side in one partition."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        with np.errstate(all="ignore"):
            narrow, lengths = a.vectors.astype(np.float32), np.sqrt((a.vectors * a.vectors).sum(axis=1))
            lengths[np.isnan(lengths)] = np.inf
            lists = _Lists(a)
            # the group whose rows may not have ended: its key, scores against the negatives, and scores for the queries (NaN without any)
            key, against, waiting = None, None, np.full(len(lengths), np.nan)

            def kept(s: np.ndarray, q: np.ndarray) -> np.ndarray:
                return ~(s >= a.thresholds[a.against[q]])

            def close() -> None:
                q = np.flatnonzero(~np.isnan(waiting))
                q = q[kept(against[a.against[q]], q)]
                lists.add(q, pa.array([key]), np.zeros(len(q), np.int64), waiting[q])
                waiting[:] = np.nan

            for keys, m in _chunks(batches, a.vectors.shape[1], FIRST_ROWS, _rows_for(len(a.negatives))):
                # bounds may rise while the hits of a chunk are added
                if not len(a.negatives):
                    for row, q, score in _hits(m, a, narrow, lengths, lists.bound):
                        lists.add(q, keys, row, score)
                else:
                    run, s = _best_by_run(keys, m, a.negatives)
                    s = np.column_stack([s, np.full(len(s), -np.inf)])
                    if key == keys[0].as_py():
                        s[0] = np.maximum(s[0], against)
                        against = s[0]
                    if key is not None and (key != keys[0].as_py() or run[-1]):
                        close()
                    for row, q, score in _hits(m, a, narrow, lengths, lists.bound):
                        ended = run[row] < run[-1]
                        np.fmax.at(waiting, q[~ended], score[~ended])
                        row, q, score = row[ended], q[ended], score[ended]
                        good = kept(s[run[row], a.against[q]], q)
                        lists.add(q[good], keys, row[good], score[good])
                    key, against = keys[-1].as_py(), s[-1]
                yield from lists.taken(HELD)
            if key is not None:
                close()
            yield from lists.taken()

    return best


def _search(rows: DataFrame, asked: _Asked) -> DataFrame:
    """(query_id, rank, key, score): the best groups of a block of queries."""
    found = rows.mapInArrow(_searcher(rows.sparkSession.sparkContext.broadcast(asked)), "query_id long, k long, key string, score double")
    # one exchange serves the groups and the ranks
    whole = found.repartition("query_id").groupBy("query_id", "k", "key").agg(F.max("score").alias("score"))
    return _rank(whole).filter("rank <= k")


def _floors(rows: DataFrame, asked: _Asked) -> np.ndarray:
    """The score of every query's k-th best group among a sample of whole groups, which that of all groups can't be below; -inf where there are fewer."""
    out = np.full(len(asked.ids), -np.inf)
    some = _search(rows.filter(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0), asked).filter("rank = k").select("query_id", "score")
    place = {q: i for i, q in enumerate(asked.ids.tolist())}
    for r in some.collect():
        out[place[r[0]]] = r[1]
    return out


def exclusion_threshold(scores: Column, precision: str = "double") -> Column:
    """Threshold between two clusters of a list of scores, or null.

    Scores that aren't finite don't count; fewer than four give null.  The
    sorted scores' places n div 4 and 3 n div 4 start two means, which are
    refined up to 16 times until they move by less than 1e-6 together; the
    threshold is halfway.  It is null if the start values are equal or a side
    becomes empty.
    """
    k = precision
    s = F.sort_array(F.filter(scores, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))).cast(f"array<{k}>")
    zero = F.lit(0.0).cast(k)

    def mean(total: Column, n: Column) -> Column:
        return (total / n.cast(k)).cast(k)

    def step(state: Column, _: Column) -> Column:
        mid = ((state["lo"] + state["hi"]) * F.lit(0.5).cast(k)).cast(k)
        start = F.struct(zero.alias("a"), F.lit(0).alias("n"), zero.alias("b"), F.lit(0).alias("m"))
        sums = F.aggregate(
            state["s"],
            start,
            lambda acc, x: F.struct(
                F.when(x < mid, (acc["a"] + x).cast(k)).otherwise(acc["a"]).alias("a"),
                (acc["n"] + F.when(x < mid, 1).otherwise(0)).alias("n"),
                F.when(x < mid, acc["b"]).otherwise((acc["b"] + x).cast(k)).alias("b"),
                (acc["m"] + F.when(x < mid, 0).otherwise(1)).alias("m"),
            ),
        )

        def settle(t: Column) -> Column:
            empty = (t["n"] == 0) | (t["m"] == 0)
            lo, hi = mean(t["a"], F.greatest(t["n"], F.lit(1))), mean(t["b"], F.greatest(t["m"], F.lit(1)))
            still = F.abs(lo - state["lo"]) + F.abs(hi - state["hi"]) < 1e-6
            return F.struct(
                F.when(empty, state["lo"]).otherwise(lo).cast(k).alias("lo"),
                F.when(empty, state["hi"]).otherwise(hi).cast(k).alias("hi"),
                (empty | still).alias("done"),
                (state["ok"] & ~empty).alias("ok"),
                state["s"].alias("s"),
            )

        return F.when(state["done"], state).otherwise(F.element_at(F.transform(F.array(sums), settle), 1))

    n = F.size(s)
    low = F.element_at(s, F.floor(n / 4).cast("int") + 1)
    high = F.element_at(s, F.floor(n * 3 / 4).cast("int") + 1)
    first = F.struct(F.coalesce(low, zero).alias("lo"), F.coalesce(high, zero).alias("hi"), F.lit(False).alias("done"), F.lit(True).alias("ok"), s.alias("s"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(16)), first, step)
    return F.when((n >= 4) & (high > low), F.when(end["ok"], ((end["lo"] + end["hi"]) * F.lit(0.5).cast(k)).cast(k)))


def two_means(values: np.ndarray) -> float | None:
    """:func:`exclusion_threshold` of an array, in float64."""
    s = np.sort(values[np.isfinite(values)])
    n = len(s)
    if n < 4 or not s[3 * n // 4] > s[n // 4]:
        return None
    low, high = s[n // 4], s[3 * n // 4]
    for _ in range(16):
        cut = np.searchsorted(s, (low + high) * 0.5)
        if cut in (0, n):
            return None
        means = s[:cut].mean(), s[cut:].mean()
        moved = abs(means[0] - low) + abs(means[1] - high)
        low, high = means
        if moved < 1e-6:
            break
    return float((low + high) * 0.5)


def _one_threshold(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    values = rows["score"].to_numpy().astype(np.float64)
    return pa.table({"query_id": pa.array([key[0].as_py()], pa.int64()), "threshold": pa.array([two_means(values)], pa.float64())})


def _threshold_of_parts(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows["scores"].chunks])
    return pa.table({"query_id": pa.array([key[0].as_py()], pa.int64()), "threshold": pa.array([two_means(values)], pa.float64())})


def _group_scores(rows: DataFrame, negatives: np.ndarray) -> DataFrame:
    """(query_id, scores): pieces of the lists of every group's score against each vector, by the vector's number."""
    shared = rows.sparkSession.sparkContext.broadcast(negatives)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece(parts: list[np.ndarray]) -> pa.RecordBatch:
            s = np.concatenate(parts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(s.shape[1] + 1) * len(s), pa.int32()), pa.array(s.T.ravel()))
            return pa.record_batch([pa.array(np.arange(s.shape[1])), lists], names=["query_id", "scores"])

        n = shared.value
        parts: list[np.ndarray] = []
        key, last = None, None
        with np.errstate(all="ignore"):
            for keys, m in _chunks(batches, n.shape[1], _rows_for(len(n)), _rows_for(len(n))):
                s = _best_by_run(keys, m, n)[1]
                if key == keys[0].as_py():
                    s[0] = np.maximum(s[0], last)
                elif key is not None:
                    parts.append(last[None])
                parts.append(s[:-1])
                key, last = keys[-1].as_py(), s[-1]
                if sum(map(len, parts)) >= 1 << 15:
                    yield piece(parts)
                    parts = []
        if key is not None:
            yield piece([*parts, last[None]])

    return rows.mapInArrow(score, "query_id long, scores array<double>")


def _negative_thresholds(rows: DataFrame, negatives: np.ndarray, threshold_groups: int) -> np.ndarray:
    """The threshold of each vector, NaN where there is none; ``rows`` have a group's rows side by side.

    The scores of so many vectors at a time are written as take no more room than the rows themselves, or 64 MB.
    """
    out = np.full(len(negatives), np.nan)
    step = max(1, negatives.shape[1] // 2, (8 << 20) // max(1, rows.count()))
    for i in range(0, len(negatives), step):
        parts = checkpointed(_group_scores(rows, negatives[i : i + step]))
        groups = parts.filter("query_id = 0").agg(F.sum(F.size("scores"))).first()[0] or 0
        if groups <= threshold_groups:
            found = parts.groupBy("query_id").applyInArrow(_threshold_of_parts, "query_id long, threshold double")
        else:
            found = thresholds(parts.select("query_id", F.explode("scores").alias("score")), threshold_groups)
        for r in found.collect():
            if r["threshold"] is not None:
                out[i + r["query_id"]] = r["threshold"]
        if i + step < len(negatives):
            # the block's files are removed when they are collected as garbage
            del parts, found
            gc.collect()
            rows.sparkSession.sparkContext._jvm.System.gc()
    return out


def _query_blocks(queries: DataFrame, columns: list[str]) -> Iterator[list[dict]]:
    """The query rows in blocks that may be sent to the executors, each of one width; one block is held at a time."""
    held: dict[int, list[dict]] = {}
    for r in queries.select(*columns).toLocalIterator(prefetchPartitions=True):
        d = r.asDict()
        v = d["vector"]
        if d["query_id"] is None or v is None or not len(v) or any(x is None for x in v):
            continue
        own = held.setdefault(len(v), [])
        own.append(d)
        if len(own) >= QUERY_BLOCK or 16 * len(v) * len(own) >= QUERY_BYTES:
            yield held.pop(len(v))
    yield from held.values()


def _rank(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(w))


def top_k(index: DataFrame, queries: DataFrame, key: str = "key", vector: str = "embedding", threshold_groups: int = 2_000_000) -> DataFrame:
    """(query_id, rank, key, score): the best groups of every query.

    ``queries`` has (query_id, vector, k) and may have ``negative`` vectors:
    where there is one, groups whose best inner product with it reaches the
    query's :func:`exclusion_threshold` drop out first.  A group's score is
    its best row's (NaN never is; a group of NaN alone scores -inf and ranks
    last); of equal scores, to nine decimals, the smaller key goes first.
    Index rows with null key or vector, or of another width than a query's,
    don't count for it; queries with null id, vector or elements, and null or
    non-positive k, give no rows.  ``threshold_groups`` bounds the groups
    whose scores are sorted in one row; beyond it thresholds are found by
    aggregates over all groups.
    """
    spark = index.sparkSession
    columns = ["query_id", "vector", "k", *(["negative"] if "negative" in queries.columns else [])]
    plain = index.select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<float>").alias("vector")).filter("key is not null and vector is not null")
    side_by_side, known = None, {}
    out = None
    for number, rows in enumerate(_query_blocks(queries.filter("k > 0"), columns), 1):
        q = np.array([r["vector"] for r in rows], np.float64)
        own: dict[bytes, int] = {}
        against = np.array([-1 if r.get("negative") is None else own.setdefault(np.array(r["negative"], np.float64).tobytes(), len(own)) for r in rows])
        negatives = np.array([np.frombuffer(x) for x in own]) if own else np.empty((0, q.shape[1]))
        if own:
            if side_by_side is None:
                side_by_side = checkpointed(plain.repartition("key").sortWithinPartitions("key"))
            new = [x for x in own if (q.shape[1], x) not in known]
            if new:
                found = _negative_thresholds(side_by_side, np.array([np.frombuffer(x) for x in new]), threshold_groups)
                known |= {(q.shape[1], x): t for x, t in zip(new, found, strict=True)}
        asked = _Asked(
            np.array([r["query_id"] for r in rows], np.int64), q, np.array([min(r["k"], 2**31 - 1) for r in rows], np.int64), np.full(len(rows), -np.inf),
            against, negatives, np.array([*(known[q.shape[1], x] for x in own), np.nan]),
        )
        source = side_by_side if own else plain
        if len(rows) >= SAMPLED_QUERIES:
            asked = asked._replace(floor=_floors(source, asked))
        ranked = _search(source, asked).select("query_id", "rank", "key", "score")
        if number > OPEN_BLOCKS:
            ranked = checkpointed(ranked)
        out = ranked if out is None else out.unionByName(ranked)
    return spark.createDataFrame([], "query_id long, rank int, key string, score double") if out is None else out


def thresholds(scores: DataFrame, threshold_groups: int = 2_000_000) -> DataFrame:
    """(query_id, threshold) from one row (query_id, score) a group; see :func:`exclusion_threshold`."""
    most = scores.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    if most <= threshold_groups:
        return scores.groupBy("query_id").applyInArrow(_one_threshold, "query_id long, threshold double")
    kept = checkpointed(scores.filter("score is not null and not isnan(score) and abs(score) < double('inf')"))
    state = _quartiles(kept).filter("n >= 4 and hi > lo").select("query_id", "lo", "hi", F.lit(False).alias("done"), F.lit(True).alias("ok"))
    for _ in range(16):
        mid = (F.col("lo") + F.col("hi")) * 0.5
        sums = kept.join(state.filter("not done"), "query_id").groupBy("query_id").agg(
            F.avg(F.when(F.col("score") < mid, F.col("score"))).alias("a"), F.avg(F.when(F.col("score") >= mid, F.col("score"))).alias("b")
        )
        moved = state.join(sums, "query_id", "left")
        empty = F.col("a").isNull() | F.col("b").isNull()
        still = F.abs(F.col("a") - F.col("lo")) + F.abs(F.col("b") - F.col("hi")) < 1e-6
        state = checkpointed(
            moved.select(
                "query_id",
                F.when(F.col("done") | empty, F.col("lo")).otherwise(F.col("a")).alias("lo"),
                F.when(F.col("done") | empty, F.col("hi")).otherwise(F.col("b")).alias("hi"),
                (F.col("done") | empty | still).alias("done"),
                (F.col("ok") & (F.col("done") | ~empty)).alias("ok"),
            )
        )
        if state.filter("not done").isEmpty():
            break
    return state.select("query_id", F.when(F.col("ok"), (F.col("lo") + F.col("hi")) * 0.5).alias("threshold"))


def _quartiles(kept: DataFrame) -> DataFrame:
    """(query_id, n, lo, hi): the scores at places n div 4 and 3 n div 4, found between approximate bounds of their ranks."""
    n = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("score", F.array(*map(F.lit, (0.24, 0.26, 0.74, 0.76))), 10_000).alias("p"))
    out = None
    for name, place, a, b in (("lo", F.floor(F.col("n") / 4), 0, 1), ("hi", F.floor(F.col("n") * 3 / 4), 2, 3)):
        low, high = F.col("p")[a], F.col("p")[b]
        joined = kept.join(n, "query_id")
        under = joined.filter(F.col("score") < low).groupBy("query_id").agg(F.count(F.lit(1)).alias("under"))
        inside = joined.filter((F.col("score") >= low) & (F.col("score") <= high)).groupBy("query_id", "score", "n").agg(F.count(F.lit(1)).alias("c"))
        run = F.sum("c").over(Window.partitionBy("query_id").orderBy("score"))
        at = (
            inside.join(under, "query_id", "left")
            .withColumn("end", run + F.coalesce("under", F.lit(0)))
            .filter(F.col("end") > place)
            .groupBy("query_id", "n")
            .agg(F.min("score").alias(name))
        )
        out = at if out is None else out.join(at, ["query_id", "n"])
    return out
