"""Queries and SQL for changes between snapshots (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.snapshots import snapshot_changes
from ..sources.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "index_snapshot"), table(spark, sf_dir, "build_request"))


_P4_SQL = """
WITH listed AS (
  SELECT library, snapshot_no, key, 'full' AS view, fingerprint,
         row_number() OVER (PARTITION BY library, snapshot_no, key ORDER BY position DESC NULLS LAST, fingerprint DESC) AS rn
  FROM index_snapshot WHERE library IS NOT NULL AND snapshot_no IS NOT NULL AND key IS NOT NULL AND fingerprint IS NOT NULL
), delivery AS (
  SELECT *, row_number() OVER (PARTITION BY library, snapshot_no ORDER BY delivered_at DESC NULLS LAST, build_id DESC) AS rn
  FROM build_request WHERE entries IS NOT NULL AND library IS NOT NULL AND snapshot_no IS NOT NULL AND build_id IS NOT NULL
), entry AS (
  SELECT library, snapshot_no, unnest(entries) AS e, unnest(range(len(entries))) AS pos FROM delivery WHERE rn = 1
), built AS (
  SELECT library, snapshot_no, e.key AS key, coalesce(e.view, 'full') AS view, e.fingerprint AS fingerprint,
         row_number() OVER (PARTITION BY library, snapshot_no, e.key, coalesce(e.view, 'full') ORDER BY pos DESC) AS rn
  FROM entry WHERE e.key IS NOT NULL AND e.fingerprint IS NOT NULL
), item AS (
  SELECT 'index' AS feed, library, snapshot_no, key, view, fingerprint FROM listed WHERE rn = 1
  UNION ALL SELECT 'build', library, snapshot_no, key, view, fingerprint FROM built WHERE rn = 1
), state AS (
  SELECT feed, library, snapshot_no, lag(snapshot_no) OVER (PARTITION BY feed, library ORDER BY snapshot_no) AS before
  FROM (SELECT DISTINCT 'index' AS feed, library, snapshot_no FROM listed
        UNION ALL SELECT 'build', library, snapshot_no FROM delivery WHERE rn = 1)
), newer AS (
  SELECT i.*, s.before FROM item i JOIN state s USING (feed, library, snapshot_no) WHERE s.before IS NOT NULL
), older AS (
  SELECT i.feed, i.library, s.snapshot_no, i.key, i.view, i.fingerprint
  FROM item i JOIN state s ON s.feed = i.feed AND s.library = i.library AND s.before = i.snapshot_no
)
SELECT coalesce(n.feed, o.feed) AS feed, coalesce(n.library, o.library) AS library,
       coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no, coalesce(n.key, o.key) AS key, coalesce(n.view, o.view) AS view,
       CASE WHEN o.feed IS NULL THEN 'added' WHEN n.feed IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM newer n FULL JOIN older o
  ON n.feed = o.feed AND n.library = o.library AND n.snapshot_no = o.snapshot_no AND n.key = o.key AND n.view = o.view
WHERE o.feed IS NULL OR n.feed IS NULL OR n.fingerprint <> o.fingerprint
"""

QUERIES = {"p4_found": p4_found}
SQL = {"p4_found": _P4_SQL}
