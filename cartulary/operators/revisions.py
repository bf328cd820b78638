"""Content revisions, gates on unchanged content and the state after a log of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concept_revision(raw: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(raw, 256))


def workspace_revision(files: DataFrame) -> DataFrame:
    """One row (files, revision) that depends on every (path, content) but not on their order.

    Hashes of the rows are added up in four parts, so partial sums are combined before the exchange and nothing is
    sorted or gathered. Rows below ``.cartulary/`` don't count; repeated rows count once.
    """
    own = files.filter(~F.col("path").startswith(".cartulary/")).select("path", F.sha2(F.col("raw"), 256).alias("h")).distinct()
    row = own.select(F.sha2(F.concat_ws("\x00", "path", "h"), 256).alias("r"))
    parts = [F.sum(F.conv(F.substring("r", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    sums = row.agg(F.count("*").alias("files"), *parts)
    text = F.concat_ws(":", F.col("files").cast("string"), *(F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(4)))
    return sums.select("files", F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("revision"))


def gate(current: DataFrame, incoming: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """What a delivery changes: (key, op), ``upsert`` for new or different content, ``delete`` for what isn't in it.

    Both sides have one row a key.
    """
    a = current.select(key, F.col(value).alias("old"), F.lit(True).alias("was"))
    b = incoming.select(key, F.col(value).alias("new"), F.lit(True).alias("is"))
    both = a.join(b, key, "full")
    op = F.when(F.col("is").isNull(), "delete").when(F.col("was").isNull() | ~F.col("old").eqNullSafe(F.col("new")), "upsert")
    return both.select(key, op.alias("op")).filter("op IS NOT NULL")


def final_state(log: DataFrame, key: str, at: list[str], *columns: str) -> DataFrame:
    """Last row of each key in order of ``at``: (key, columns). Maxima are combined before the exchange."""
    last = F.max(F.struct(*at, *columns)).alias("r")
    return log.filter(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, *(F.col(f"r.{c}").alias(c) for c in columns))
