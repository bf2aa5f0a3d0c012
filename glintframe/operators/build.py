"""Building an index incrementally: what can be reused, what must be encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def catalog_entries(requests: DataFrame, entries: str = "entries") -> DataFrame:
    """The entries of build requests, one row each, with their position; a null view means ``full``, null entries are none."""
    keep = [c for c in requests.columns if c not in (entries, "fingerprint")]
    return requests.select(*keep, F.posexplode(entries).alias("position", "_e")).filter("_e is not null").select(
        *keep, "position", F.col("_e.key").alias("key"), F.col("_e.path").alias("path"), F.col("_e.fingerprint").alias("fingerprint"), F.coalesce("_e.view", F.lit("full")).alias("view")
    )


def fingerprint_map(entries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, key, fingerprint): the fingerprint of every key's last entry (highest position, then fingerprint)."""
    return entries.groupBy(*by, "key").agg(F.max(F.struct("position", "fingerprint")).alias("_l")).select(*by, "key", F.col("_l.fingerprint").alias("fingerprint"))


def plan_reuse(catalog: DataFrame, cached: DataFrame, by: tuple[str, ...] = (), vector: str = "embedding", own: tuple[str, ...] = ()) -> DataFrame:
    """The catalog with the cached vector of every entry that can be reused, and ``reused``.

    An entry reuses the vector of a cached row with its (key, fingerprint).
    A cached row serves one entry of a build (``by``), the first by position;
    further entries with the same key and fingerprint are encoded anew.  Of
    several cached rows with one key and fingerprint the last counts.  Null
    keys and fingerprints match nothing.  Where every build has a cache of its
    ``own``, these columns of ``by`` name the build that a cached row is for.
    """
    turn = Window.partitionBy(*by, "key", "fingerprint").orderBy("position")
    numbered = catalog.withColumn("_turn", F.row_number().over(turn))
    last = cached.groupBy(*own, "key", "fingerprint").agg(F.max_by(vector, "position").alias(vector)).withColumn("_turn", F.lit(1))
    joined = numbered.join(last, [*own, "key", "fingerprint", "_turn"], "left").drop("_turn")
    return joined.withColumn("reused", F.col(vector).isNotNull())


def plan_counts(plan: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, total, reused, missing, keys) of a plan."""
    return plan.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("reused"), 1)).alias("reused"),
        F.count(F.when(~F.col("reused"), 1)).alias("missing"),
        F.countDistinct("key").alias("keys"),
    )


def usable_cache(header: dict | None, entries: DataFrame, model: str, dimensions: int, vector: str = "embedding") -> DataFrame:
    """The cached rows, or none of them where the old index has another model or width."""
    if not header or header.get("model") != model or header.get("dimensions") != dimensions:
        return entries.limit(0)
    return entries.filter(F.size(vector) == dimensions)


def build_index(catalog: DataFrame, cached: DataFrame, encode: Callable[[DataFrame], DataFrame], dimensions: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The new index (position, key, fingerprint, vector) and the entries that couldn't be encoded.

    ``encode`` gets the missing entries and returns them with the columns
    ``vector`` and ``error``; it isn't called where nothing is missing.
    Entries with an error or without a vector are skipped, a vector of
    another width than ``dimensions`` or without direction is an error that
    raises when the index is computed.  An empty catalog raises at once.
    """
    from ..functions.vectors import normalise

    if catalog.isEmpty():
        raise ValueError("the catalog is empty")
    plan = plan_reuse(catalog, cached, vector=vector)
    missing = plan.filter("not reused").drop(vector, "reused")
    columns = ["position", "key", "fingerprint", vector]
    old = plan.filter("reused").select(columns)
    if missing.isEmpty():
        return old, missing.withColumn("error", F.lit(None).cast("string")).limit(0)
    encoded = encode(missing)
    good = encoded.filter(F.col("error").isNull() & F.col(vector).isNotNull())
    unit: Column = normalise(F.col(vector), precision="float").cast("array<float>")
    fresh = good.withColumn(
        vector,
        F.when(F.size(vector) != dimensions, F.raise_error(F.concat(F.lit("wrong width for key "), "key"))).otherwise(F.coalesce(unit, F.raise_error(F.concat(F.lit("no direction for key "), "key")).cast("array<float>"))),
    )
    return old.unionByName(fresh.select(columns)), encoded.filter(F.col("error").isNotNull() | F.col(vector).isNull())


def index_statistics(entries: DataFrame, by: tuple[str, ...], vector: str = "embedding") -> DataFrame:
    """(*by, records, unique_keys, min_norm, median_norm, max_norm, bytes) of finite vectors; bytes are those of the entries in an index file."""
    from ..functions.vectors import finite, norm

    sound = entries.withColumn("_n", F.when(F.coalesce(finite(F.col(vector)), F.lit(False)), norm(F.col(vector))))
    return sound.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("key").alias("unique_keys"),
        F.min("_n").alias("min_norm"), F.median("_n").alias("median_norm"), F.max("_n").alias("max_norm"),
        F.sum(12 + F.coalesce(F.octet_length("key"), F.lit(0)) + 4 * F.coalesce(F.size(vector), F.lit(0))).alias("bytes"),
    )


def deterministic_pool(items: DataFrame, anchors: DataFrame, size: int) -> DataFrame:
    """(key, is_anchor): all anchors, filled up to ``size`` with the other items of the smallest SHA-256 of the key.

    Raises if there are more anchors than ``size`` or an anchor isn't among
    the items.  Repeated keys count once, null keys never.
    """
    keys = items.select("key").filter("key is not null").distinct()
    wanted = anchors.select("key").filter("key is not null").distinct()
    n = wanted.count()
    if size < n:
        raise ValueError("the pool is smaller than the number of anchors")
    lost = [r[0] for r in wanted.join(keys, "key", "left_anti").limit(5).collect()]
    if lost:
        raise ValueError(f"anchors missing from the items: {', '.join(sorted(lost))}")
    others = keys.join(wanted, "key", "left_anti").orderBy(F.sha2(F.col("key").cast("binary"), 256), "key").limit(size - n)
    return wanted.withColumn("is_anchor", F.lit(True)).unionByName(others.withColumn("is_anchor", F.lit(False)))


def sample_vectors(sample: DataFrame, entries: DataFrame, by: tuple[str, ...] = (), vector: str = "embedding") -> DataFrame:
    """The rows of ``sample`` whose key an index holds, each with the vector of the key's last entry there (highest position).

    ``entries`` has (*by, key, position, vector); with ``by`` a row joins every
    index that has its key.  Null keys match nothing; rows of the sample that
    repeat a key stay.  A key has one entry an index left before the join, so
    a key that very many rows of the sample share only meets a few rows.
    """
    last = entries.filter("key is not null").groupBy(*by, "key").agg(F.max_by(vector, "position").alias(vector))
    return sample.join(last, "key")


def presence(ledger: DataFrame, installed: DataFrame, on: str) -> DataFrame:
    """Full outer join of a ledger with what is there, and the ``state``: ``active``, ``missing`` or ``inactive``."""
    a, b = ledger.withColumn("_a", F.lit(True)), installed.withColumn("_b", F.lit(True))
    state = F.when(F.col("_a") & F.col("_b"), "active").when(F.col("_a"), "missing").otherwise("inactive")
    return a.join(b, on, "full_outer").withColumn("state", state).drop("_a", "_b")


def unshared(files: DataFrame, owner: str, path: str) -> DataFrame:
    """The distinct (owner, path) whose path no other owner uses."""
    own = files.select(owner, path).filter(F.col(path).isNotNull()).distinct()
    several = own.groupBy(path).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return own.join(several, path, "left_anti").select(owner, path)
