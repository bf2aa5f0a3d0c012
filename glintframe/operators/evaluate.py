"""Retrieval quality: metrics of rankings, agreement of models, percentiles, acceptance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("precision_at_k", "recall_at_k", "average_precision_at_k", "ndcg_at_k", "reciprocal_rank", "required_at_k", "forbidden_at_k")


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank.cast("double") + 1.0)


def _ideal(n: Column) -> Column:
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, r: s + _gain(r))).otherwise(F.lit(0.0))


def retrieval_metrics(ranked: DataFrame, judged: DataFrame, k: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Metrics of every query's first ``k`` results.

    ``ranked`` has (*by, rank, relevant, required, forbidden) with booleans
    (null is false); ``judged`` has (*by, positives, returned): the relevant
    items of the whole collection and the length of the query's whole
    ranking.  A query without results or positives has zeros.  Precision,
    required and forbidden divide by ``k``, average precision and nDCG by
    what is possible.
    """
    if k < 1:
        raise ValueError("k must be positive")
    first = ranked.filter(F.col("rank") <= k)
    running = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    yes = lambda c: F.when(F.col(c), 1).otherwise(0)
    hits = first.withColumn("_hit", yes("relevant")).withColumn("_found", F.sum("_hit").over(running))
    sums = hits.groupBy(*by).agg(
        F.sum("_hit").alias("_hits"),
        F.sum(F.when(F.col("_hit") == 1, F.col("_found") / F.col("rank"))).alias("_ap"),
        F.sum(F.when(F.col("_hit") == 1, _gain(F.col("rank")))).alias("_dcg"),
        F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("_first"),
        F.sum(yes("required")).alias("_required"),
        F.sum(yes("forbidden")).alias("_forbidden"),
    )
    possible = F.least(F.col("positives"), F.col("returned"), F.lit(k))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return judged.join(sums, list(by), "left").select(
        *by,
        F.col("positives").alias("positive_count"),
        zero(F.col("_hits") / k).alias("precision_at_k"),
        zero(F.when(F.col("positives") > 0, F.col("_hits") / F.col("positives"))).alias("recall_at_k"),
        zero(F.when(possible > 0, F.col("_ap") / possible)).alias("average_precision_at_k"),
        zero(F.when(possible > 0, F.col("_dcg") / _ideal(possible))).alias("ndcg_at_k"),
        zero(1.0 / F.col("_first")).alias("reciprocal_rank"),
        zero(F.col("_required") / k).alias("required_at_k"),
        zero(F.col("_forbidden") / k).alias("forbidden_at_k"),
    )


def rerank(ranked: DataFrame, keep: Column, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The rows that ``keep`` holds for, with ranks 1, 2, ... in their old order."""
    w = Window.partitionBy(*by).orderBy("rank")
    return ranked.filter(F.coalesce(keep, F.lit(False))).withColumn("rank", F.row_number().over(w))


def mean_metrics(metrics: DataFrame, kind: str | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Means over queries with positives; with ``kind`` by kind and, in rows of null kind, over all."""
    used = metrics.filter("positive_count > 0")
    means = [F.avg(m).alias(m) for m in METRICS] + [F.count(F.lit(1)).alias("queries")]
    if kind is None:
        return used.groupBy(*extra).agg(*means)
    total = used.groupBy(*extra).agg(*means).withColumn(kind, F.lit(None).cast("string"))
    parts = used.groupBy(*extra, kind).agg(*means)
    return parts.unionByName(total)


def percentile_nearest(value: str | Column, p: float) -> Column:
    """Nearest-rank percentile (place ceil(n p) of the sorted values; ``p`` = 0 gives the largest); null without values."""
    c = F.col(value) if isinstance(value, str) else value
    if p == 0:
        return F.max(c)
    return F.expr(f"percentile_disc({p}) within group (order by `{value}`)") if isinstance(value, str) else F.percentile_approx(c, p)


def percentile_linear(value: str | Column, p: float) -> Column:
    """Exact percentile with linear interpolation."""
    return F.percentile(value, F.lit(p))


def anchor_summary(ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summary of (rank, query_ms) of the anchors that queries look for."""
    hit = lambda k: F.avg((F.col("rank") <= k).cast("double")).alias(f"hit_at_{k}")
    return ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"), hit(1), hit(5), hit(10),
        F.avg(F.lit(1.0) / F.col("rank")).alias("mean_reciprocal_rank"),
        F.median("rank").alias("median_rank"), F.max("rank").alias("worst_rank"), F.avg("query_ms").alias("mean_query_ms"),
    )


def tag_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query, precision_at_1, hit_at_5, precision_at_5, average_precision, ndcg, relevant) of tag queries.

    ``ranked`` has (query, rank, key), ``relevant`` the distinct (query, key).
    Queries without relevant keys have null average precision.
    """
    judged = ranked.filter(F.col("rank") <= k).join(relevant.withColumn("_hit", F.lit(1)), ["query", "key"], "left")
    running = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.coalesce("_hit", F.lit(0))
    counted = judged.withColumn("_found", F.sum(hit).over(running))
    sums = counted.groupBy("query").agg(
        F.max(F.when(F.col("rank") == 1, hit)).cast("double").alias("precision_at_1"),
        F.max(F.when(F.col("rank") <= 5, hit)).cast("double").alias("hit_at_5"),
        (F.sum(F.when(F.col("rank") <= 5, hit)) / 5).alias("precision_at_5"),
        F.sum(F.when(hit == 1, F.col("_found") / F.col("rank"))).alias("_ap"),
        F.sum(F.when(hit == 1, _gain(F.col("rank")))).alias("_dcg"),
    )
    sizes = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("relevant"))
    full = sums.join(sizes, "query", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    possible = F.least(F.col("relevant"), F.lit(k))
    return full.select(
        "query", "precision_at_1", "hit_at_5", "precision_at_5", "relevant",
        F.when(possible > 0, F.coalesce("_ap", F.lit(0.0)) / possible).alias("average_precision"),
        F.when(possible > 0, F.coalesce("_dcg", F.lit(0.0)) / _ideal(possible)).otherwise(0.0).alias("ndcg"),
    )


def key_lists(ranked: DataFrame, k: int, by: Sequence[str] = ("model", "query_id")) -> DataFrame:
    """(*by, keys): every query's first ``k`` keys in order."""
    first = ranked.filter(F.col("rank") <= k)
    return first.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "key"))), lambda r: r["key"]).alias("keys"))


def _shared(a: Column, b: Column, k: int, m: int | None = None) -> Column:
    return F.size(F.array_intersect(F.slice(a, 1, k), F.slice(b, 1, m or k)))


def overlap_of(a: Column, b: Column, k: int) -> Column:
    """Shared keys of two first-k lists over k."""
    return _shared(a, b, k) / k


def bounded_overlap_of(a: Column, b: Column, k: int) -> Column:
    """Shared keys over the most there can be; null where a list is empty."""
    most = F.least(F.lit(k), F.size(a), F.size(b))
    return F.when(most > 0, _shared(a, b, k) / most)


def recall_of(teacher: Column, student: Column, wanted: int, looked: int) -> Column:
    """Share of the teacher's first ``wanted`` among the student's first ``looked``."""
    most = F.least(F.lit(wanted), F.size(teacher))
    return F.when(most > 0, _shared(teacher, student, wanted, looked) / most)


def model_agreement(lists: DataFrame, counts: Sequence[int] = (1, 3, 10)) -> DataFrame:
    """(left_model, right_model, queries, top<k>): mean overlap of every two models (left < right) over their common queries."""
    a = lists.select("query_id", F.col("model").alias("left_model"), F.col("keys").alias("a"))
    b = lists.select("query_id", F.col("model").alias("right_model"), F.col("keys").alias("b"))
    pairs = a.join(b, "query_id").filter("left_model < right_model")
    return pairs.groupBy("left_model", "right_model").agg(F.count(F.lit(1)).alias("queries"), *[F.avg(overlap_of(F.col("a"), F.col("b"), k)).alias(f"top{k}") for k in counts])


def retrieval_fidelity(lists: DataFrame, teacher: str, student: str) -> DataFrame:
    """One row: agreement of a student's lists with a teacher's (first 50 keys each)."""
    t = lists.filter(F.col("model") == teacher).select("query_id", F.col("keys").alias("t"))
    s = lists.filter(F.col("model") == student).select("query_id", F.col("keys").alias("s"))
    t_, s_ = F.col("t"), F.col("s")
    return t.join(s, "query_id").agg(
        F.avg((t_[0] == s_[0]).cast("double")).alias("top1_agreement"),
        F.avg(recall_of(t_, s_, 3, 3)).alias("top3_overlap"),
        F.avg(recall_of(t_, s_, 3, 5)).alias("teacher_top3_recall_at_5"),
        F.avg(recall_of(t_, s_, 10, 10)).alias("top10_overlap"),
        F.avg(recall_of(t_, s_, 10, 50)).alias("teacher_top10_recall_at_50"),
    )


def acceptance(metrics: DataFrame, minimums: DataFrame) -> DataFrame:
    """(metric, actual, minimum) of the metrics (metric, actual) that miss their minimum; missing or null ones do."""
    joined = minimums.join(metrics, "metric", "left")
    return joined.filter(F.col("actual").isNull() | F.isnan("actual") | (F.col("actual") < F.col("minimum"))).select("metric", "actual", "minimum")


def paired(left: DataFrame, right: DataFrame, on: Sequence[str] = ("ordinal",)) -> DataFrame:
    """Two results joined position by position; a position that only one of them has raises when it is read."""
    a, b = left.withColumn("_a", F.lit(True)), right.withColumn("_b", F.lit(True))
    both = a.join(b, list(on), "full_outer")
    return both.filter(F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("the results differ in length"))).otherwise(F.lit(True))).drop("_a", "_b")
