"""Queries of the core by name: callables for Spark and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.operators import references, snapshots
from cartulary.plans import notes, states
from cartulary.session import materialize, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = snapshots.snapshot_changes(table(spark, d, "file_snapshots"), table(spark, d, "snapshots"))
    return out.select("snap_no", F.col("key").alias("path"), "change")


def p4_intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = snapshots.current_rows(table(spark, d, "file_snapshots"))
    return snapshots.validity_intervals(rows).withColumnRenamed("key", "path")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(
        table(spark, d, "links"), table(spark, d, "files"), table(spark, d, "file_snapshots")
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("link_id", "side", "reason")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d))


def p6_state(spark: SparkSession, d: str) -> DataFrame:
    """Orphan keys after the last delivery, from counts that each delivery's delta has added to and taken from."""
    snaps, taken = table(spark, d, "file_snapshots"), table(spark, d, "snapshots")
    deltas = materialize(references.present_deltas(snaps, taken, table(spark, d, "links")))
    state = references.ReferenceState(spark, f"{shared_dir(spark)}/cartulary-references-{uuid.uuid4().hex}")
    last = taken.agg(F.max("snap_no")).first()[0] or 0
    for n in range(1, last + 1):
        state.apply(n, deltas.filter(F.col("snap_no") == n).drop("snap_no"))
    return references.orphan_keys(state.counts()).select("path", "refs", "reason")


_P6 = """
    SELECT l.link_id, l.side, min(l.seen_at) AS seen_at,
           CASE WHEN f.path IS NOT NULL THEN 'late' WHEN h.path IS NOT NULL THEN 'deleted' ELSE 'missing' END AS reason
    FROM (SELECT link_id, 'src' AS side, src AS path, seen_at FROM links
          UNION ALL SELECT link_id, 'dst', dst, seen_at FROM links) l
    LEFT JOIN (SELECT path, min(first_seen) AS first_seen FROM files GROUP BY path) f ON f.path = l.path
    LEFT JOIN (SELECT DISTINCT path FROM file_snapshots) h ON h.path = l.path
    WHERE l.path IS NOT NULL AND (f.path IS NULL OR f.first_seen > l.seen_at)
    GROUP BY ALL"""

_P4 = """
    WITH one AS (
      SELECT path, snap_no, hash AS h, frontmatter_json AS f FROM file_snapshots
      WHERE path IS NOT NULL AND snap_no IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY path, snap_no ORDER BY loaded_at DESC, hash DESC) = 1),
    cur AS (
      SELECT path, snap_no, h, CASE WHEN f IS NOT NULL THEN coalesce(
               (SELECT list(k || ':' || (f -> ('$."' || k || '"'))::VARCHAR ORDER BY k)::VARCHAR
                FROM unnest(json_keys(f)) t(k)), '[]') END AS j
      FROM one)"""

_RUNS = """
    r AS (SELECT path, min(snap_no) AS first, max(snap_no) AS last FROM (
            SELECT path, snap_no, snap_no - row_number() OVER (PARTITION BY path ORDER BY snap_no) AS run
            FROM (SELECT DISTINCT path, snap_no FROM file_snapshots WHERE path IS NOT NULL AND snap_no IS NOT NULL)) GROUP BY path, run),
    m AS (SELECT max(snap_no) AS m FROM snapshots),
    now AS (SELECT path, taken_at AS came FROM r JOIN snapshots s ON s.snap_no = r.first WHERE last = (SELECT m FROM m))"""

SQL_P = {
    "p6_state": f"""WITH {_RUNS},
      refs AS (SELECT dst AS path, count(*) AS refs, min(seen_at) AS first_ref FROM (
                 SELECT link_id, src, dst, min(seen_at) AS seen_at FROM links WHERE src IN (SELECT path FROM now) AND dst IS NOT NULL GROUP BY ALL) GROUP BY dst)
      SELECT * FROM (SELECT f.path, f.refs, CASE WHEN n.path IS NOT NULL THEN CASE WHEN n.came > f.first_ref THEN 'late' END
                WHEN f.path IN (SELECT path FROM r WHERE last < (SELECT m FROM m)) THEN 'deleted' ELSE 'missing' END AS reason
             FROM refs f LEFT JOIN now n ON n.path = f.path) WHERE reason IS NOT NULL""",
    "p4_found": f"""{_P4}
      SELECT coalesce(b.snap_no, a.snap_no + 1)::INT AS snap_no, coalesce(b.path, a.path) AS path,
             CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
      FROM cur a FULL JOIN cur b ON a.path = b.path AND b.snap_no = a.snap_no + 1
      WHERE coalesce(b.snap_no, a.snap_no + 1) BETWEEN 2 AND (SELECT max(snap_no) FROM snapshots)
        AND (a.path IS NULL OR b.path IS NULL OR a.h <> b.h OR a.j <> b.j)""",
    "p6_found": f"SELECT DISTINCT link_id, side, reason FROM ({_P6})",
    "p6_report": f"SELECT side, reason, strftime(seen_at, '%Y-%m') AS month, count(*) AS n FROM ({_P6}) GROUP BY ALL",
}


def queries() -> dict[str, Query]:
    return {"p4_found": p4_found, "p4_intervals": p4_intervals, "p6_found": p6_found, "p6_report": p6_report, "p6_state": p6_state} | notes.QUERIES | states.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL_P | notes.SQL | states.SQL
