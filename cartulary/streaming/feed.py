"""An incremental corpus on Structured Streaming: a log of changes keeps a table of current files up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartulary.sources.parted import PartedTable, part_of

CHANGES = "seq bigint, path string, op string, raw string"
STATE = "path string, raw string, hash binary, part int"
#: Parts by hash of the path; a batch rewrites only the parts that it touches.
PARTS = 32


def state_of(files: DataFrame) -> DataFrame:
    """A whole corpus (path, raw) as state: (path, raw, hash, part)."""
    return files.select("path", "raw", F.unhex(F.sha2("raw", 256)).alias("hash"), part_of("path", PARTS).alias("part"))


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each path in a batch: (path, op, raw); rows with a null path are no changes."""
    last = F.max(F.struct("seq", "op", "raw")).alias("c")
    return changes.filter("path IS NOT NULL").groupBy("path").agg(last).select("path", "c.op", "c.raw")


def effects(state: DataFrame, changes: DataFrame) -> DataFrame:
    """What really changes: (path, event, raw, hash, part). Upserts of equal content and removals of absent paths have
    no effect and give no row."""
    new = last_changes(changes)
    new = new.select("path", "op", "raw", F.unhex(F.sha2("raw", 256)).alias("hash"), part_of("path", PARTS).alias("part"))
    own = state.select("path", F.col("hash").alias("old"), F.lit(True).alias("was"))
    both = new.join(own, "path", "left")
    event = F.when((F.col("op") == "remove") & F.col("was"), "removed").when((F.col("op") == "upsert") & ~F.col("hash").eqNullSafe(F.col("old")), "changed")
    return both.withColumn("event", event).filter("event IS NOT NULL").select("path", "event", "raw", "hash", "part")


def step(state: DataFrame, effect: DataFrame) -> DataFrame:
    """State after effects: the touched paths are taken out and what changed is put in."""
    kept = state.join(effect.select("path"), "path", "left_anti")
    return kept.unionByName(effect.filter("event = 'changed'").select("path", "raw", "hash", "part"))


class Feed:
    """The current files in ``folder`` with an event table beside them.

    The state is a table of numbered versions. A batch that is delivered again finds its number there and does nothing.
    Events go to a folder of their batch, so a batch that was broken off writes them anew.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.table = PartedTable(spark, folder, STATE, PARTS)

    def state(self) -> DataFrame:
        return self.table.read()

    def events(self) -> DataFrame:
        schema = "path string, event string, batch bigint"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/events") if self.table.exists("events") else self.spark.createDataFrame([], schema)

    def apply(self, changes: DataFrame, batch: int) -> None:
        """One batch of changes (seq, path, op, raw); ``op`` is upsert or remove. Nothing is written without effect."""
        from cartulary.session import materialize, release

        if batch <= self.table.last():
            return
        effect = materialize(effects(self.table.read(), changes))
        touched = self.table.parts_of(effect)  # at most PARTS rows
        if touched:
            effect.select("path", "event").write.mode("overwrite").parquet(f"{self.folder}/events/batch={batch}")
        self.table.write(batch, touched, step(self.table.read(touched), effect))
        release(effect)

    def rebuild(self, files: DataFrame, batch: int = 0) -> None:
        """The state from a whole corpus, in one version."""
        self.table.write(batch, list(range(PARTS)), state_of(files))

    def follow(self, changes: DataFrame, every: str = "250 milliseconds", once: bool = False) -> StreamingQuery:
        """Applies a stream of changes (seq, path, op, raw). ``once``: what is there now, then ends."""
        writer = changes.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(lambda df, n: self.apply(df, n + 1))
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()

    def start(self, log: str, every: str = "250 milliseconds", once: bool = False) -> StreamingQuery:
        """Follows a folder of JSON changes."""
        return self.follow(self.spark.readStream.schema(CHANGES).json(log), every, once)


def reconcile(state: DataFrame, files: DataFrame) -> DataFrame:
    """Changes that bring a state to a whole corpus: (path, op, raw)."""
    own = state.select("path", F.col("hash").alias("old"))
    new = files.select("path", "raw", F.unhex(F.sha2("raw", 256)).alias("hash"))
    both = own.join(new, "path", "full").filter("NOT (old <=> hash)")
    return both.select("path", F.when(F.col("hash").isNull(), "remove").otherwise("upsert").alias("op"), "raw")
