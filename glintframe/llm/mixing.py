"""Mixing sources to target weights by Sainte-Lague apportionment.

The wanted total is cut into equal blocks of tokens, so many that every shard
of an average source can have several.  Each block goes to the source of the
highest quotient share / (2 n + 1), n being the blocks it has, among those
whose repeats aren't used up; the blocks of a source go in the same way to its
shards, by their tokens.  Within a shard the documents are put into a seeded
order and the quota is filled: whole repeats first, the rest from the front.
No step sees more than a shard, and its rows are sorted, not held.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import checkpointed
from .tokens import PATTERN, TOKENIZERS, VOCABULARY, vocabulary

#: Blocks that the total is cut into at least, and for each (source, shard); documents of a shard.
BLOCKS = 1_000_000
BLOCKS_A_SHARD = 64
SHARD_ROWS = 20_000
#: (source, shard) pairs whose token sums the driver apportions; with more documents shards are larger.
MAX_SHARDS = 1_000_000
#: Multiples of it spread evenly over 0 to 1.
GOLDEN = 0.6180339887498949


def apportion(weights: dict, caps: dict, seats: int) -> dict:
    """Seats of every key by Sainte-Lague among those below their cap; equal quotients go to the smaller key.

    Keys without weight or cap get none.  Fewer seats are given only if all
    caps are reached.  A key with n seats has all its quotients
    weight / 1, 3, ... (2 n - 1) above a divisor that all keys share; it is
    found by bisection, so the work doesn't grow with the seats.
    """
    given = dict.fromkeys(weights, 0)
    keys = sorted((k for k, w in weights.items() if w and w > 0 and caps.get(k, 0) > 0), key=str)
    w, cap = np.array([weights[k] for k in keys], np.float64), np.array([caps[k] for k in keys], np.float64)
    seats = int(min(max(0, seats), cap.sum()))
    if not seats:
        return given

    def above(divisor: float) -> np.ndarray:
        return np.minimum(cap, np.floor((w / divisor + 1) / 2))

    few = 2 * w.max()
    many = few
    while above(many).sum() < seats:
        many /= 2
    while (middle := (few + many) / 2) not in (few, many):
        few, many = (middle, many) if above(middle).sum() <= seats else (few, middle)
    n = above(few)
    # what is left are quotients equal to the divisor
    heap = [(-x / (2 * m + 1), k) for k, (x, m, c) in enumerate(zip(w, n, cap, strict=True)) if m < c]
    heapq.heapify(heap)
    for _ in range(seats - int(n.sum())):
        _, k = heapq.heappop(heap)
        n[k] += 1
        if n[k] < cap[k]:
            heapq.heappush(heap, (-w[k] / (2 * n[k] + 1), k))
    return given | {k: int(m) for k, m in zip(keys, n, strict=True)}


def quotas(sums: dict[str, dict[int, int]], aims: dict[str, tuple[float, int]], total: int) -> list[tuple[str, int, int]]:
    """(source, shard, tokens) of the mixture from every source's tokens by shard and its (share, most repeats).

    A source's blocks are whole; what a shard can't hold of its blocks, being
    used up, goes to the source's other shards.
    """
    have = {s: sum(v.values()) for s, v in sums.items()}
    block = max(1, total // max(BLOCKS, BLOCKS_A_SHARD * sum(map(len, sums.values()))))
    blocks = apportion({s: a[0] for s, a in aims.items()}, {s: -(-have[s] * aims[s][1] // block) for s in aims}, -(-total // block))
    out = []
    for s, n in blocks.items():
        if not n:
            continue
        shards = sorted(sums[s])
        most = np.array([sums[s][k] * aims[s][1] for k in shards], np.int64)
        wanted = min(n * block, int(most.sum()))
        own = apportion(sums[s], {k: -(-m // block) for k, m in zip(shards, most.tolist(), strict=True)}, n)
        got = np.minimum(np.array([own[k] for k in shards], np.int64) * block, most)
        room = np.cumsum(most - got)
        got += np.diff(np.minimum(room, wanted - got.sum()), prepend=0)
        out += [(s, k, q) for k, q in zip(shards, got.tolist(), strict=True) if q]
    return out


@lru_cache(maxsize=1)
def _encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=vocabulary(path), special_tokens={})


def token_sizes(documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, tokens): sizes of the texts by ``byte_bpe_50k``; null and empty texts have 0."""
    path = str(Path(tokenizers) / VOCABULARY)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encode = _encoding(path).encode_ordinary
            sizes = [len(encode(t)) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], batch["source"], pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(measure, "doc_id long, source string, tokens long")


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1, tokenizers: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, tokens, copies) and the shares reached.

    ``targets`` has one row a source: (source, target_share, max_repeats);
    null or non-positive shares and repeats mean nothing of that source, of
    several rows of a source the largest share and repeats hold.  The total
    is ``total_tokens`` or else the tokens of all documents of a source with
    a target.  Of each shard the document that its quota ends in is taken or
    left by a spread number of the shard, so that the sums come out right
    however small quotas are.  A source that can't reach its share is used with all its
    repeats and the others fill up by their weights; if all are used up the
    total stays below.  Documents of null source, of a source without
    target, without tokens or with null id are in no mixture.

    The report has (source, target_share, actual_share, tokens,
    available_tokens, documents, max_copies) of every target; shares are of
    the mixture's tokens and are 0 in an empty one.
    """
    wanted = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    aims = {r["source"]: (max(0.0, r["target_share"] or 0.0), max(0, r["max_repeats"] or 0)) for r in wanted.collect()}
    # the count comes from the files' footers
    shards = max(1, min(-(-documents.count() // SHARD_ROWS), MAX_SHARDS // max(1, len(aims))))
    sized = token_sizes(documents.join(wanted.select("source"), "source", "left_semi"), tokenizers).filter("tokens > 0 and doc_id is not null")
    sized = checkpointed(sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)).cast("int")))
    sums: dict[str, dict[int, int]] = {s: {} for s in aims}
    for r in sized.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")).collect():
        sums[r["source"]][r["shard"]] = r["tokens"]
    have = {s: sum(v.values()) for s, v in sums.items()}
    parts = [(s, k, q // sums[s][k], q % sums[s][k]) for s, k, q in quotas(sums, aims, sum(have.values()) if total_tokens is None else total_tokens)]
    spark = documents.sparkSession
    plan = spark.createDataFrame(parts, "source string, shard int, whole long, rest long")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    before = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    spread = F.pmod((F.col("shard") + 1) * F.lit(GOLDEN), F.lit(1.0))
    placed = sized.withColumn("edge", before + F.col("tokens") * spread)
    mixed = (
        placed.join(plan, ["source", "shard"])
        .withColumn("copies", (F.col("whole") + (F.col("edge") < F.col("rest")).cast("long")).cast("int"))
        .filter("copies > 0")
        .select("doc_id", "source", "tokens", "copies")
    )
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("max_copies"))
    available = spark.createDataFrame([(s, a[0], have[s]) for s, a in aims.items()], "source string, target_share double, available_tokens long")
    full = available.join(used, "source", "left").fillna(0, ["tokens", "documents", "max_copies"])
    # one row a target
    report = full.withColumn("_all", F.sum("tokens").over(Window.partitionBy())).select(
        "source", "target_share", F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).otherwise(0.0).alias("actual_share"), "tokens", "available_tokens", "documents", "max_copies"
    )
    return mixed, report
