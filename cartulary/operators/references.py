"""References to records that don't exist, from signed reference and existence counts per key.

The state has a row per key, kind and time with a signed count: references by when they were seen, records by when they
came, and past records. Counts are sums, so whatever a delta adds another can take back, the first time of a key too:
it is the earliest that still has a positive count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartulary.session import materialize, release, skew_safe_join, small_or_not
from cartulary.sources.parted import PartedTable

STATE = "path string, what string, at timestamp, n bigint"
#: Parts by hash of the key that a kept state is stored in; a delta rewrites only those that it touches.
PARTS = 32


def link_rows(links: DataFrame) -> DataFrame:
    """Distinct references by side: (link_id, side, path, seen_at). Null paths are no references; a link that was
    delivered several times counts once, with its earliest ``seen_at``."""
    sides = F.array(
        F.struct(F.lit("src").alias("side"), F.col("src").alias("path")),
        F.struct(F.lit("dst").alias("side"), F.col("dst").alias("path")),
    )
    return (
        links.groupBy("link_id", "src", "dst")
        .agg(F.min("seen_at").alias("seen_at"))
        .select("link_id", F.explode(sides).alias("s"), "seen_at")
        .select("link_id", F.col("s.side").alias("side"), F.col("s.path").alias("path"), "seen_at")
        .filter(F.col("path").isNotNull())
    )


def _delta(rows: DataFrame, what: str, at, n) -> DataFrame:
    return rows.filter("path IS NOT NULL").select(*_columns(what, at, n))


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """Deltas of references (path, seen_at) that came (``sign`` 1) or went (-1)."""
    return _delta(refs, "reference", F.col("seen_at"), F.lit(sign))


def record_deltas(records: DataFrame, first_seen: str | None = None, sign: int = 1, current: bool = True) -> DataFrame:
    """Deltas of records that came or went, one of each path. ``current`` False: they are only known to have existed at
    some time."""
    seen = F.min(first_seen) if first_seen else F.lit(None)
    own = records.groupBy("path").agg(seen.cast("timestamp").alias("seen"))
    return _delta(own, "record" if current else "past", F.col("seen") if current else F.lit(None), F.lit(sign))


def apply_deltas(*deltas: DataFrame) -> DataFrame:
    """State after deltas (a former state is a delta too): the sums of signed counts, without those that are zero."""
    whole = reduce(DataFrame.unionByName, deltas)
    return whole.groupBy("path", "what", "at").agg(F.sum("n").alias("n")).filter("n <> 0")


def key_counts(state: DataFrame) -> DataFrame:
    """(path, refs, existing, ever, first_seen, first_ref) of each key of a state, or of deltas that only add."""
    of = lambda what: F.col("what") == what
    count_ = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    first = lambda what: F.min(F.when(of(what) & (F.col("n") > 0), F.col("at")))
    return state.groupBy("path").agg(
        count_(of("reference")).alias("refs"), count_(of("record")).alias("existing"), count_(of("past")).alias("ever"), first("record").alias("first_seen"), first("reference").alias("first_ref")
    )


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys with positive references and zero existence (``deleted`` or ``missing``), and those first seen after a
    reference (``late``): (path, refs, reason, first_seen)."""
    return _with_reason(key_counts(state)).filter(F.col("reason").isNotNull())


def _with_reason(keys: DataFrame) -> DataFrame:
    gone = F.when(F.col("ever") > 0, "deleted").otherwise("missing")
    late = F.when(F.col("first_seen") > F.col("first_ref"), "late")
    reason = F.when(F.col("refs") > 0, F.when(F.col("existing") <= 0, gone).otherwise(late))
    return keys.select("path", "refs", reason.alias("reason"), "first_seen")


class ReferenceState:
    """The counts in ``folder``, kept up to date by deltas that are numbered from 0; one that is delivered again does
    nothing. Only the parts that a delta touches are rewritten."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = PartedTable(spark, folder, STATE, PARTS)

    def counts(self) -> DataFrame:
        return self.table.read()

    def apply(self, batch: int, *deltas: DataFrame) -> None:
        if batch <= self.table.last():
            return
        delta = materialize(apply_deltas(*deltas))
        touched = self.table.parts_of(delta)
        self.table.write(batch, touched, apply_deltas(self.table.read(touched), delta))
        release(delta)


def present_deltas(snaps: DataFrame, snapshots: DataFrame, links: DataFrame) -> DataFrame:
    """Deltas by which each delivery of a table of records changes the counts: (snap_no, path, what, at, n).

    ``snaps`` has (path, snap_no), ``snapshots`` (snap_no, taken_at), numbered one by one. A path is there from the
    first to the last of consecutive deliveries; it comes with the first of these, at its ``taken_at``, and goes with
    the one after them. References (link_id, src, dst, seen_at) to ``dst`` come and go with their source.
    """
    w = Window.partitionBy("path").orderBy("snap_no")
    own = snaps.filter("path IS NOT NULL AND snap_no IS NOT NULL").select("path", F.col("snap_no").cast("int").alias("snap_no")).distinct()
    runs = own.withColumn("run", F.col("snap_no") - F.row_number().over(w)).groupBy("path", "run").agg(F.min("snap_no").alias("first"), F.max("snap_no").alias("last"))
    at = snapshots.select(F.col("snap_no").cast("int").alias("first"), F.col("taken_at").alias("came"))
    runs = materialize(runs.join(small_or_not(materialize(at)), "first"))
    change = F.explode(F.array(F.struct(F.col("first").alias("snap_no"), F.lit(1).alias("n")), F.struct((F.col("last") + 1).alias("snap_no"), F.lit(-1).alias("n")))).alias("c")
    records = runs.select("path", "came", change).select("c.snap_no", "path", "came", "c.n")
    parts = [records.select("snap_no", *_columns("record", F.col("came"), F.col("n")))]
    parts.append(records.filter("n < 0").select("snap_no", *_columns("past", F.lit(None), F.lit(1))))
    refs = links.filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("link_id", "src", "dst").agg(F.min("seen_at").alias("seen_at"))
    refs = refs.join(runs.select(F.col("path").alias("src"), "first", "last"), "src").select(F.col("dst").alias("path"), "seen_at", change).select("c.snap_no", "path", "seen_at", "c.n")
    parts.append(refs.select("snap_no", *_columns("reference", F.col("seen_at"), F.col("n"))))
    return reduce(DataFrame.unionByName, parts)


def _columns(what: str, at, n):
    return F.col("path"), F.lit(what).alias("what"), at.cast("timestamp").alias("at"), n.cast("bigint").alias("n")


def orphan_references(links: DataFrame, files: DataFrame, history: DataFrame) -> DataFrame:
    """Every reference to a record that is missing, deleted or came later: (link_id, side, reason, seen_at).

    ``files`` holds the current records with ``first_seen``, ``history`` any row of former states. A null ``seen_at``
    or ``first_seen`` is never late. Keys that hold much of the references (their number is in the state) are joined by
    broadcast, of which there can't be more than a thousand; all others through an exchange. Only the keys that are
    reported or hot are written between the two passes.
    """
    refs = link_rows(links)
    # from nothing on deltas only add, so they are summed by key at once
    deltas = reference_deltas(refs), record_deltas(files, "first_seen"), record_deltas(history, current=False)
    state = key_counts(reduce(DataFrame.unionByName, deltas))
    total = 2 * links.count()  # a bound: each link has two sides
    keys = materialize(_with_reason(state).filter(F.col("reason").isNotNull() | (F.col("refs") > total / 1000)))
    hit = skew_safe_join(refs, keys, "path", "refs", total).filter(F.col("reason").isNotNull())
    return (
        hit.filter((F.col("reason") != "late") | (F.col("first_seen") > F.col("seen_at")))
        .select("link_id", "side", "reason", "seen_at")
        .groupBy("link_id", "side", "reason")
        .agg(F.min("seen_at").alias("seen_at"))
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per side, reason and month of ``seen_at`` (null if unknown): (side, reason, month, n)."""
    return orphans.groupBy("side", "reason", F.date_format("seen_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n")
    )
