"""Session settings, materialised intermediate tables and size-checked joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Most rows that are ever broadcast after counting them.
BROADCAST_ROWS = 1_000_000
#: Most bytes of values, counted row by row and not as compressed files, of what is broadcast.
BROADCAST_BYTES = 32 << 20

_written: dict[str, SparkSession] = {}


def session(app: str = "cartulary", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time; ``conf`` overrides single settings."""
    b = SparkSession.builder.appName(app).config(
        map={
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
            **conf,
        }
    )
    spark = b.getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of a context, once, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="cartulary-"), "cartulary-package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine.

    On a cluster an unset folder raises a RuntimeError, as a folder of one machine would lose tables with it.
    """
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        name = f"file://{tempfile.mkdtemp(prefix='cartulary-')}"
        spark.conf.set("spark.checkpoint.dir", name)
    return name.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _cleanup() -> None:
    for path in list(_written):
        try:
            _delete(_written.pop(path), path)
        except Exception:  # the session has ended; the folder's owner removes the rest
            return


atexit.register(_cleanup)


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    The table survives the loss of executors, cuts the lineage and is computed once however often it is read. It is
    removed by ``release``, at the end of a ``scratch`` block, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cartulary-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._cartulary_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Removes the files of tables that ``materialize`` gave, after their last use; anything else is passed over."""
    for t in tables:
        path = getattr(t, "_cartulary_path", None)
        if path in _written:
            _delete(_written.pop(path), path)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes at its end every table that was materialised within the block; results must have been read or written
    by then."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            _delete(_written.pop(path), path)


def plan_bytes(df: DataFrame) -> int:
    """Size that the optimizer expects: of a written table that of its files, else an estimate on the safe side."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _value_bytes(name: str, kind: DataType) -> Column:
    """Bytes of a value in a row: eight for the slot, and what a text, a list or anything nested holds."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 8
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) + 8
    return F.lit(8)


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows of at most ``most`` bytes together, both counted, else
    as it is, to be joined by an exchange.

    ``df`` should be materialised and narrow; the count stops at ``rows`` + 1, and isn't begun where the files alone are
    larger than ``most``.
    """
    if plan_bytes(df) > most:
        return df
    width = reduce(lambda a, b: a + b, (_value_bytes(f.name, f.dataType) for f in df.schema), F.lit(16))
    n, size = df.select(width.alias("w")).limit(rows + 1).agg(F.count("*"), F.sum("w")).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= most else df


def skew_safe_join(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join on ``key`` where ``right`` has one row per key and ``weight``, the number of ``left`` rows of that key.

    ``right`` must hold every key that has more than ``total`` / ``share`` left rows.

    Keys that hold more than 1/``share`` of ``total`` left rows number fewer than ``share``, so they are broadcast; the
    remaining rows join through an ordinary exchange in which no key is hot.
    """
    keys = [key] if isinstance(key, str) else key
    hot = F.col(weight) > F.lit(total) / F.lit(share)
    heavy = right.filter(hot)
    first = left.join(F.broadcast(heavy), keys)
    light = right.filter(~hot)
    rest = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return first.unionByName(rest)


def spread_small(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A table in fewer files than there are cores, and of at most ``most`` bytes by the statistics of its plan, spread over
    all cores before work in Python.

    Such a table comes in one or two row groups, whatever the number of its partitions. Others are left as they are, so
    nothing is exchanged at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan_bytes(df) <= most and len(df.inputFiles()) < cores else df
