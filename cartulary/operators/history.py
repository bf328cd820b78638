"""Versions of a corpus: conformance of each, the last that conforms, how far two histories are apart, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conformance(checks: DataFrame, versions: DataFrame) -> DataFrame:
    """(version, hard_fail, warn_count, conform) for every one of ``versions``; ``checks`` has (version, path, level)."""
    per = checks.groupBy("version", "path").agg(F.max((F.col("level") == "err").cast("int")).alias("e"), F.count_if(F.col("level") == "warn").alias("w"))
    sums = per.groupBy("version").agg(F.sum("e").alias("e"), F.sum("w").alias("w"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return versions.select("version").distinct().join(sums, "version", "left").select("version", zero("e").alias("hard_fail"), zero("w").alias("warn_count"), (zero("e") == 0).alias("conform"))


def last_conforming(conformance_: DataFrame) -> DataFrame:
    """The newest version without an error: one row (version), null if there is none."""
    return conformance_.filter("conform").agg(F.max("version").alias("version"))


def ahead_behind(commits: DataFrame, a: str, b: str) -> tuple[int, int]:
    """How many commits are only in the ancestry of ``a`` and only in that of ``b``; ``commits`` has (id, parent)."""
    from cartulary.operators.graph import reach

    spark = commits.sparkSession
    edges = commits.filter("parent IS NOT NULL").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    own = [reach(edges, spark.createDataFrame([(x,)], "node string"), "out").select("node") for x in (a, b)]
    return own[0].join(own[1], "node", "left_anti").count(), own[1].join(own[0], "node", "left_anti").count()


def expired(receipts: DataFrame, now: int, most: int = 20, seconds: int = 86_400) -> DataFrame:
    """Receipts (name, mtime) to be removed: older than ``seconds``, or beyond the newest ``most``.

    Only the newest ``most`` are kept by a sort with a limit, so nothing is ranked as a whole.
    """
    kept = receipts.filter(F.col("mtime") >= now - seconds).orderBy(F.desc("mtime"), F.desc("name")).limit(most)
    return receipts.join(kept.select("name"), "name", "left_anti")


def status_changes(before: DataFrame, after: DataFrame, column: str = "status") -> DataFrame:
    """Keys in both states whose value differs, a null counting as empty: (path, before, after)."""
    text = lambda df, n: df.select("path", F.coalesce(column, F.lit("")).alias(n))
    return text(before, "before").join(text(after, "after"), "path").filter("before <> after")

