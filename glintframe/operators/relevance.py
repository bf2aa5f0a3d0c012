"""Cutting a ranked list to its relevant part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def relevant(ranked: DataFrame, by: Sequence[str], score: str = "score", rank: str = "rank", window: str = "score_window", prominence: str = "min_score_prominence", least: str = "min_results", most: str = "max_results") -> DataFrame:
    """The rows of each list that count as relevant, with their ranks.

    ``ranked`` has a list's rows with ranks 1, 2, ... and, on each row, the
    list's settings; null settings don't apply (null ``least`` is 0).  A list
    of four rows or more whose best score exceeds the score in its middle
    (place n div 2 from 0) by less than ``prominence`` isn't prominent and
    keeps ``least`` rows, whatever ``most`` says.  Any other keeps the rows
    within ``window`` of its best, at least ``least`` and at most ``most``.
    """
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    best = F.max(score).over(w)
    middle = F.max(F.when(F.col(rank) == F.floor(F.col("_n") / 2) + 1, F.col(score))).over(w)
    inside = F.sum(F.when(F.col(window).isNull() | (F.col(score) >= F.col("_best") - F.col(window)), 1).otherwise(0)).over(w)
    few = F.least(F.coalesce(F.col(least), F.lit(0)), F.col("_n"))
    many = F.least(F.coalesce(F.col(most), F.col("_n")), F.col("_n"))
    prominent = F.col(prominence).isNull() | (F.col("_n") < 4) | (F.col("_best") - F.col("_middle") >= F.col(prominence))
    keep = F.when(prominent, F.least(F.greatest(F.col("_inside"), few), many)).otherwise(few)
    staged = ranked.withColumns({"_n": n, "_best": best}).withColumns({"_middle": middle, "_inside": inside})
    return staged.filter(F.col(rank) <= keep).drop("_n", "_best", "_middle", "_inside")
