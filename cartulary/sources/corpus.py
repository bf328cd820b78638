"""Corpora from folders, archives and tables as ``files`` (path, raw) DataFrames, and settings of a workspace."""

from __future__ import annotations

import io
import os
import re
import tomllib
import zipfile
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions.paths import file_kind, rel_path, under

#: Folders that are never part of a corpus.
SKIPPED = (".cartulary", ".git")
FILES = "path string, raw string"


def _ignore_pattern(line: str) -> str | None:
    """One line of an ignore file as a pattern of relative paths."""
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    rooted = "/" in line.rstrip("/")
    folder, name = line.endswith("/"), line.strip("/")
    out = ""
    for part in re.findall(r"\*\*/|/\*\*|\*|\?|[^*?/]+|/", name):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return ("^" if rooted else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$")


def ignored(path: Column, lines: list[str] | dict[str, list[str]]) -> Column:
    """Whether the last ignore line that fits a path ignores it (``!`` takes it back).

    ``lines`` are those of the root, or of each folder (with its slash at the end, '' for the root); the lines of a folder
    count for what lies in it and come after those of the folders above.
    """
    out = F.lit(False)
    by_folder = lines if isinstance(lines, dict) else {"": lines}
    for folder in sorted(by_folder, key=lambda f: (f.count("/"), f)):
        for line in by_folder[folder]:
            keep = line.startswith("!")
            pattern = _ignore_pattern(line[keep:])
            if pattern:
                fits = F.startswith(path, F.lit(folder)) & F.substr(path, F.lit(len(folder) + 1)).rlike(pattern)
                out = F.when(fits, not keep).otherwise(out)
    return out


def ignore_files(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Lines of every ignore file under an address, by folder; listed by the driver like the files themselves."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.makeQualified(base).toString().rstrip("/") + "/"
    found, out = fs.listFiles(base, True), {}
    while found.hasNext():
        p = found.next().getPath()
        if p.getName() == ".gitignore":
            stream = fs.open(p)
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            out[p.toString().removeprefix(top).removesuffix(".gitignore")] = text.splitlines()
    return out


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files under ``root``: (path, raw, mtime, size). Hidden files count, skipped folders and what
    ignore files name, at the root or below, don't; files that aren't UTF-8 and invalid paths are left out.

    A mounted folder is listed by the driver, as Spark's own sources do, and read by the executors. Any other address is
    left to Spark's binary file source, which passes over names that begin with a dot or an underscore.
    """
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    if re.match(r"^\w+:/", base):
        df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(base)
        prefix = "^.*?" + re.escape(re.sub(r"^\w+:/*[^/]*", "", base)) + "/"
        rows = df.select(
            F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), prefix, "").alias("path"),
            F.try_validate_utf8(F.col("content").cast("string")).alias("raw"),
            F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"),
        )
        lines = ignore_files(spark, base)
    else:
        names, lines = [], {}
        for folder, below, files in os.walk(base):
            below[:] = sorted(d for d in below if d not in SKIPPED)
            names += [os.path.relpath(os.path.join(folder, f), base) for f in files if f.endswith(".md")]
            if ".gitignore" in files:
                within = "" if folder == base else os.path.relpath(folder, base).replace(os.sep, "/") + "/"
                lines[within] = Path(folder, ".gitignore").read_text(encoding="utf-8").splitlines()
        parts = max(1, min(len(names) // 500 + 1, 10 * spark.sparkContext.defaultParallelism))
        listed = spark.createDataFrame(pd.DataFrame({"path": pd.Series(names, dtype="object")}), "path string").repartition(parts)
        rows = listed.mapInArrow(_reader(base), "path string, raw string, mtime bigint, size bigint")
    rows = rows.withColumn("path", rel_path("path")).filter("path IS NOT NULL AND raw IS NOT NULL")
    return rows.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))) & ~ignored(F.col("path"), lines))


def _reader(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                names = whole.column(0).slice(i, 200).to_pylist()
                rows = []
                for n in names:
                    p = Path(base, n)
                    try:
                        data, stat = p.read_bytes(), p.stat()
                        rows.append((n, data.decode("utf-8"), int(stat.st_mtime), stat.st_size))
                    except (UnicodeDecodeError, FileNotFoundError):
                        continue
                columns = zip(*rows, strict=True) if rows else [()] * 4
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["path", "raw", "mtime", "size"])

    return run


def scan_zip(spark: SparkSession, pattern: str) -> DataFrame:
    """Markdown entries of ZIP archives: (path, raw). Unsafe paths and entries that aren't UTF-8 are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                names, texts = [], []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for e in z.infolist():
                        if e.filename.endswith(".md"):
                            try:
                                texts.append(z.read(e).decode("utf-8"))
                            except UnicodeDecodeError:
                                continue
                            names.append(e.filename)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["path", "raw"])

    rows = spark.read.format("binaryFile").load(pattern).select("content").mapInArrow(run, FILES)
    return rows.withColumn("path", rel_path("path")).filter("path IS NOT NULL")


def from_table(df: DataFrame, path: str = "path", raw: str = "raw") -> DataFrame:
    """Any table as a corpus: valid paths, one row each (the greatest text if there are several)."""
    own = df.select(rel_path(path).alias("path"), F.col(raw).alias("raw")).filter("path IS NOT NULL AND raw IS NOT NULL")
    return own.groupBy("path").agg(F.max("raw").alias("raw"))


def at_version(df: DataFrame, version: Any, column: str = "version") -> DataFrame:
    """The state of a versioned table; the filter on ``version`` prunes its partitions."""
    return df.filter(F.col(column) == F.lit(version)).drop(column)


def staged(df: DataFrame, stage: str = "stage") -> DataFrame:
    """The state that is staged for a commit: rows of stage 0; other stages are conflicts and raise a ValueError."""
    conflicts = [r[0] for r in df.filter(F.col(stage) != 0).select("path").distinct().orderBy("path").limit(20).collect()]
    if conflicts:
        raise ValueError(f"unresolved conflicts: {', '.join(conflicts)}")
    return df.filter(F.col(stage) == 0).drop(stage)


def dirty(head: DataFrame, working: DataFrame) -> DataFrame:
    """Paths of (path, raw) states whose text differs, or that only one has: (path)."""
    a, b = head.select("path", F.col("raw").alias("a")), working.select("path", F.col("raw").alias("b"))
    return a.join(b, "path", "full").filter("NOT (a <=> b)").select("path")


def versions(df: DataFrame, limit: int = 20, column: str = "version", order: str = "taken_at") -> DataFrame:
    """The latest versions, newest first."""
    return df.select(column, order).distinct().orderBy(F.desc(order)).limit(limit)


def existing_under(spark: SparkSession, root: str, roots: list[str]) -> DataFrame:
    """Relative paths of all files that lie under any of ``roots``: (path)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root.rstrip("/")).select("path")
    rel = F.regexp_replace("path", "^.*?" + re.escape(re.sub(r"^\w+:/*", "/", root.rstrip("/"))) + "/", "")
    inside = F.lit(False)
    for r in roots:
        inside = inside | under(F.col("path"), r)
    return df.select(rel.alias("path")).filter(inside)


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    """A corpus of ``n`` notes in one ring of links with an index page: (path, raw)."""
    width = len(str(max(1, n)))
    name = lambda c: F.concat(F.lit("c"), F.lpad(c.cast("string"), width, "0"))
    i = F.col("id")
    raw = F.concat(
        F.lit("---\ntype: Concept\ntitle: Note "), i.cast("string"), F.lit("\n---\n\n# Note\n\n[next](/"), name((i + 1) % F.lit(n)), F.lit(".md)\n")
    )
    notes = spark.range(n).select(F.concat(name(i), F.lit(".md")).alias("path"), raw.alias("raw"))
    first = F.concat(F.lit("# Index\n\n* [c]("), name(F.lit(0)), F.lit(".md)\n"))
    return notes.unionByName(spark.range(1).select(F.lit("index.md").alias("path"), first.alias("raw")))


def with_kind(files: DataFrame) -> DataFrame:
    return files.withColumn("kind", file_kind("path"))


def settings(root: str | Path) -> dict[str, Any]:
    """Settings of a workspace: roots that may be written and referred to, and whether warnings block.

    ``cartulary.toml`` and ``.cartulary/config.yaml`` are read; without them everything may be written. A file that
    can't be parsed raises ValueError.
    """
    root = Path(root)
    out: dict[str, Any] = {"block_warnings": False, "writable": [], "references": [], "retain_seconds": 86400, "most_receipts": 20}
    toml, yml = root / "cartulary.toml", root / ".cartulary/config.yaml"
    if toml.is_file():
        try:
            out["block_warnings"] = bool(tomllib.loads(toml.read_text(encoding="utf-8")).get("gate", {}).get("block_warnings", False))
        except tomllib.TOMLDecodeError as e:
            raise ValueError(f"{toml}: {e}") from e
    if yml.is_file():
        import yaml

        try:
            data = yaml.safe_load(yml.read_text(encoding="utf-8")) or {}
        except yaml.YAMLError as e:
            raise ValueError(f"{yml}: {e}") from e
        w, g, t = (data.get(k) or {} for k in ("workspace", "gate", "transactions"))
        out |= {"writable": w.get("writableRoots") or [], "references": w.get("referenceRoots") or []}
        out["block_warnings"] = out["block_warnings"] or bool(g.get("blockWarnings", False))
        out |= {"retain_seconds": seconds(t.get("retainReceiptsFor", "24h")), "most_receipts": int(t.get("maximumReceipts", 20))}
    return out


def seconds(duration: str) -> int:
    """``24h``, ``10m``, ``30s`` or ``7d`` in seconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", duration)
    if not m:
        raise ValueError(f"{duration!r} is no duration")
    return int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]
