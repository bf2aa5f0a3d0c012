"""What changed between consecutive full snapshots of a table.

Every item (a key, or a key and a view) is windowed by the index that its
snapshots have in the library's sequence of states: the lagged fingerprint
shows a change, a gap in the index shows a removal and a later addition.
No state is ever joined with another one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_states(states: DataFrame, group: str = "library", order: str = "snapshot_no") -> DataFrame:
    """Adds ``state_ix`` (1, 2, ... within the group) and ``next_no`` (the order value of the following state or null).

    ``states`` has one row per state.  Rows with null group or order are no states.
    """
    w = Window.partitionBy(group).orderBy(order)
    return (
        states.filter(F.col(group).isNotNull() & F.col(order).isNotNull())
        .withColumn("state_ix", F.row_number().over(w))
        .withColumn("next_no", F.lead(order).over(w))
    )


def changes(items: DataFrame, item: Sequence[str], group: str = "library", order: str = "snapshot_no", fingerprint: str = "fingerprint") -> DataFrame:
    """Rows (group, order, *item, change) with change ``added``, ``removed`` or ``changed``.

    ``items`` holds at most one row per group, state and item, with the columns
    of :func:`number_states`; keys and fingerprints aren't null.  The first
    state of a group gives no rows; the order value is that of the newer state.
    """
    w = Window.partitionBy(group, *item).orderBy("state_ix")
    before, after = F.lag("state_ix").over(w), F.lead("state_ix").over(w)
    seen = items.select(
        group,
        order,
        *item,
        "next_no",
        F.when((F.col("state_ix") > 1) & (before.isNull() | (before < F.col("state_ix") - 1)), F.lit("added"))
        .when(before.isNotNull() & (F.lag(fingerprint).over(w) != F.col(fingerprint)), F.lit("changed"))
        .alias("_here"),
        (F.col("next_no").isNotNull() & (after.isNull() | (after > F.col("state_ix") + 1))).alias("_gone"),
    )
    cases = F.array(
        F.struct(F.col(order).alias("at"), F.col("_here").alias("change")),
        F.struct(F.col("next_no").alias("at"), F.when(F.col("_gone"), F.lit("removed")).alias("change")),
    )
    found = seen.filter(F.col("_here").isNotNull() | F.col("_gone")).select(group, *item, F.explode(cases).alias("c"))
    return found.filter("c.change is not null").select(group, F.col("c.at").alias(order), *item, "c.change")


def listing_items(listing: DataFrame) -> DataFrame:
    """Items of row-wise listings (library, snapshot_no, position, key, fingerprint), ready for :func:`changes`.

    Rows with a null library, number, key or fingerprint count for nothing.
    Of several rows of a key in a state the highest position counts (null
    lowest), of equal positions the larger fingerprint.
    """
    rows = listing.filter(" and ".join(f"{c} is not null" for c in ("library", "snapshot_no", "key", "fingerprint")))
    items = (
        rows.groupBy("library", "snapshot_no", "key")
        .agg(F.max(F.struct("position", "fingerprint")).alias("last"))
        .select("library", "snapshot_no", "key", F.col("last.fingerprint").alias("fingerprint"))
    )
    states = number_states(rows.select("library", "snapshot_no").distinct())
    return items.join(states, ["library", "snapshot_no"])


def delivery_items(deliveries: DataFrame) -> DataFrame:
    """Items of whole-catalog deliveries (build_id, library, snapshot_no, delivered_at, entries), ready for :func:`changes`.

    The state of (library, snapshot_no) is its delivery with non-null entries
    and the latest ``delivered_at`` (null earliest; of equal times the largest
    build_id).  A null view means ``full``; null entries and entries with null
    key or fingerprint count for nothing; of several entries of an item the
    last one counts.  A state without entries is a state all the same.
    """
    whole = deliveries.filter("entries is not null and library is not null and snapshot_no is not null and build_id is not null")
    latest = (
        whole.groupBy("library", "snapshot_no")
        .agg(F.max(F.struct("delivered_at", "build_id")).alias("last"))
        .select("library", "snapshot_no", F.col("last.build_id").alias("build_id"))
    )
    slim = whole.select("build_id", F.transform("entries", lambda e: F.struct(e["key"].alias("key"), e["fingerprint"].alias("fingerprint"), e["view"].alias("view"))).alias("entries"))
    entries = (
        number_states(latest)
        .join(slim, "build_id")
        .select("library", "snapshot_no", "state_ix", "next_no", "build_id", F.posexplode("entries").alias("pos", "e"))
        .filter("e.key is not null and e.fingerprint is not null")
    )
    return (
        entries.groupBy("build_id", "library", "snapshot_no", "state_ix", "next_no", F.col("e.key").alias("key"), F.coalesce("e.view", F.lit("full")).alias("view"))
        .agg(F.max_by("e.fingerprint", "pos").alias("fingerprint"))
        .drop("build_id")
    )


def snapshot_changes(listing: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(feed, library, snapshot_no, key, view, change) over both kinds of snapshots; feeds ``index`` and ``build``."""
    cols = ["feed", "library", "snapshot_no", "key", "view", "change"]
    a = changes(listing_items(listing), ["key"]).withColumns({"feed": F.lit("index"), "view": F.lit("full")}).select(cols)
    b = changes(delivery_items(deliveries), ["key", "view"]).withColumn("feed", F.lit("build")).select(cols)
    return a.unionByName(b)
