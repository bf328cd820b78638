"""A table of numbered versions, stored in parts by hash of the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def part_of(path: Column | str, parts: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(parts)).cast("int")


class PartedTable:
    """Rows with a ``path`` in ``folder``.

    A batch writes the parts that it touches to a new folder and then points to them by one small file, so a lost
    executor or driver leaves the version before.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, parts: int):
        self.spark, self.folder, self.schema, self.parts = spark, folder.rstrip("/"), schema, parts

    def exists(self, name: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(f"{self.folder}/{name}"))

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def last(self) -> int:
        """Number of the last batch, -1 before the first."""
        fs, path = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.folder}/versions"))] if self.exists("versions") else []
        return max((int(n.split("-")[1]) for n in names if n.startswith("batch-") and self.exists(f"versions/{n}/_SUCCESS")), default=-1)

    def places(self) -> dict[int, int]:
        """In which version each part stands."""
        last = self.last()
        if last < 0:
            return {}
        return {r.part: r.version for r in self.spark.read.schema("part int, version bigint").json(f"{self.folder}/versions/batch-{last}").collect()}

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those of some parts."""
        paths = [f"{self.folder}/state/v{v}/p={p}" for p, v in sorted(self.places().items()) if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def parts_of(self, rows: DataFrame) -> list[int]:
        return sorted(r.p for r in rows.select(part_of("path", self.parts).alias("p")).distinct().collect())

    def write(self, batch: int, touched: list[int], rows: DataFrame) -> None:
        """Puts ``rows`` in the place of all rows of the parts ``touched``."""
        places = self.places()
        if touched:
            names = self.spark.createDataFrame([], self.schema).columns
            new = rows.select(*names).withColumn("p", part_of("path", self.parts))
            new.repartition(len(touched), "p").write.mode("overwrite").partitionBy("p").parquet(f"{self.folder}/state/v{batch}")
            there = {p for p in touched if self.exists(f"state/v{batch}/p={p}")}
            places = {p: v for p, v in places.items() if p not in touched} | {p: batch for p in there}
        pointer = self.spark.createDataFrame(sorted(places.items()), "part int, version bigint")
        pointer.coalesce(1).write.mode("overwrite").json(f"{self.folder}/versions/batch-{batch}")
