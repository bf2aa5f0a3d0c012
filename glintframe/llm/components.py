"""Connected components: in memory for one unit, and over tables of any size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import checkpointed


def roots(parent: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The roots of the nodes ``v``; shortens the paths to them."""
    while True:
        p = parent[v]
        pp = parent[p]
        if (p == pp).all():
            return p
        parent[v] = pp


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i] for all i; the smaller root stays."""
    while len(a):
        a, b = roots(parent, a), roots(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        parent[np.maximum(a, b)] = np.minimum(a, b)


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for every node of the edges (u, v) the least node it is connected with.

    Alternates large-star and small-star steps, whose number grows with the
    logarithm of the nodes; each round is written to the checkpoint folder.
    Least neighbours come from aggregates joined back, so a node of very many
    edges is split by the skew join rather than held in one task.
    """
    now = checkpointed(_distinct_edges(edges))
    before = _checksum(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _distinct_edges(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        now = checkpointed(_distinct_edges(small))
        after = _checksum(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
