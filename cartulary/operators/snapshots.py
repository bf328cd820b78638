"""Changes between consecutive full snapshots of a table (validity intervals by gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_value(c: Column) -> Column:
    """Text that is equal for equal JSON values: sorted keys, no white space, no escapes. Text that isn't JSON stays."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def current_rows(
    snaps: DataFrame,
    key: str = "path",
    snap: str = "snap_no",
    order: str = "loaded_at",
    hash_col: str = "hash",
    json_col: str = "frontmatter_json",
) -> DataFrame:
    """One row per key and snapshot, the one with the latest ``order``: (key, snap_no, row_hash, json_hash).

    Partial aggregation before the exchange absorbs repeated rows, so a key that holds a large part of them isn't hot.
    On equal ``order`` the greater hashes win. Rows with a null key or snapshot number are no records and are left out.
    """
    return (
        snaps.filter(F.col(key).isNotNull() & F.col(snap).isNotNull())
        .select(
            F.col(key).alias("key"),
            F.col(snap).cast("int").alias("snap_no"),
            F.struct(
                F.col(order).alias("o"),
                F.col(hash_col).alias("h"),
                F.unhex(F.sha2(json_value(F.col(json_col)), 256)).alias("j"),
            ).alias("r"),
        )
        .groupBy("key", "snap_no")
        .agg(F.max("r").alias("r"))
        .select("key", "snap_no", F.col("r.h").alias("row_hash"), F.col("r.j").alias("json_hash"))
    )


def _differs(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


def validity_intervals(current: DataFrame) -> DataFrame:
    """Islands of consecutive snapshots in which a key kept its content: (key, first_snap, last_snap).

    Two neighbouring snapshots belong to one island unless a hash differs; a null hash is not compared.
    """
    w = Window.partitionBy("key").orderBy("snap_no")
    same = (
        (F.lag("snap_no").over(w) == F.col("snap_no") - 1)
        & ~_differs(F.lag("row_hash").over(w), F.col("row_hash"))
        & ~_differs(F.lag("json_hash").over(w), F.col("json_hash"))
    )
    return (
        current.withColumn("starts", F.when(same, 0).otherwise(1))
        .withColumn("island", F.sum("starts").over(w))
        .groupBy("key", "island")
        .agg(F.min("snap_no").alias("first_snap"), F.max("snap_no").alias("last_snap"))
        .select("key", "first_snap", "last_snap")
    )


def change_events(intervals: DataFrame, first: int, last: int) -> DataFrame:
    """Starts, ends and adjacencies of intervals as events: (snap_no, key, change).

    A start next to the end of the interval before is ``changed``, any other start after snapshot ``first`` is
    ``added``; an end before snapshot ``last`` without an adjacent interval is ``removed`` in the snapshot after.
    """
    w = Window.partitionBy("key").orderBy("first_snap")
    before, after = F.col("before"), F.col("after")
    start = F.when(
        F.col("first_snap") > first,
        F.struct(
            F.col("first_snap").alias("snap_no"),
            F.when(before == F.col("first_snap") - 1, "changed").otherwise("added").alias("change"),
        ),
    )
    end = F.when(
        (F.col("last_snap") < last) & F.coalesce(after != F.col("last_snap") + 1, F.lit(True)),
        F.struct((F.col("last_snap") + 1).alias("snap_no"), F.lit("removed").alias("change")),
    )
    return (
        intervals.withColumns({"before": F.lag("last_snap").over(w), "after": F.lead("first_snap").over(w)})
        .withColumn("e", F.explode(F.array_compact(F.array(start, end))))
        .select(F.col("e.snap_no").cast("int").alias("snap_no"), "key", F.col("e.change").alias("change"))
    )


def snapshot_changes(snaps: DataFrame, snapshots: DataFrame, **columns: str) -> DataFrame:
    """Which keys were added, removed or changed in each snapshot against the one before: (snap_no, key, change).

    ``snapshots`` lists the deliveries (``snap_no``), numbered one by one in order of time; the first and the last are
    read from it, so a key that vanishes in the last delivery is reported even if nothing else came in. A delivery
    without any row removes everything. Empty tables give no rows.
    """
    bounds = snapshots.agg(F.min("snap_no"), F.max("snap_no")).first()
    if bounds is None or bounds[0] is None:
        bounds = (1, 1)
    return change_events(validity_intervals(current_rows(snaps, **columns)), int(bounds[0]), int(bounds[1]))
