"""Prompts from templates, small text parsers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that a slot may have, and prompts that a pattern may make; slots are joined with each other.
MAX_WORDS = 10_000
MAX_PROMPTS = 1_000_000_000


def expand(spark: SparkSession, patterns: Sequence[str], words: Mapping[str, DataFrame], fixed: Sequence[str] = ()) -> DataFrame:
    """(prompt): the distinct prompts that filling the patterns' ``{slot}``s with all words gives, and the fixed ones.

    ``words`` has a one-column table for each slot; a pattern is joined only
    with the slots that it names.  Null words fill nothing.
    """
    out = spark.createDataFrame([(f,) for f in fixed], "prompt string")
    for pattern in patterns:
        slots = [s for s in words if "{" + s + "}" in pattern]
        rows, made = spark.createDataFrame([(pattern,)], "prompt string"), 1
        for s in slots:
            own = words[s].select(F.col(words[s].columns[0]).alias(s)).filter(F.col(s).isNotNull()).distinct()
            n = own.limit(MAX_WORDS + 1).count()
            made *= max(1, n)
            if n > MAX_WORDS or made > MAX_PROMPTS:
                raise ValueError(f"more than {MAX_WORDS} words for {s}, or more than {MAX_PROMPTS} prompts of a pattern")
            # every word with every prompt is what a grammar means; its sides are bounded above
            rows = rows.crossJoin(F.broadcast(own))
        out = out.unionByName(rows.select(reduce(lambda t, s: F.replace(t, F.lit("{" + s + "}"), F.col(s)), slots, F.col("prompt")).alias("prompt")))
    return out.distinct()


def seeded_sample(prompts: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` of the prompts in an order that the seed fixes: by hash, then by text."""
    return prompts.orderBy(F.xxhash64("prompt", F.lit(seed)), "prompt").limit(n)


def seeded_split(prompts: DataFrame, share: float, seed: int) -> DataFrame:
    """Adds ``training``: whether the prompt's seeded hash falls into the given share; each row decides alone."""
    return prompts.withColumn("training", F.pmod(F.xxhash64("prompt", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30))


def runtime_version(name: Column) -> Column:
    """The version in a name like ``libonnxruntime.so.1.22``; null without one."""
    v = F.regexp_extract(name, r"^libonnxruntime\.so\.(.+)$", 1)
    return F.when(v != "", v)


def source_path(key: Column, path: Column, static_root: str) -> Column:
    """Where an entry's file lies: ``static:`` keys below the root, others at their path."""
    return F.when(F.startswith(key, F.lit("static:")), F.concat(F.lit(static_root.rstrip("/") + "/"), F.substr(key, F.lit(8)))).otherwise(path)
