"""Writing changed files, archives and reports; only changed rows reach the driver, one partition at a time."""

from __future__ import annotations

import json
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.paths import rel_path


def write_file(root: Path, path: str, text: str) -> None:
    """Replaces a file at once: a temporary file beside it is synced and renamed over it."""
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=target.parent, prefix=".tmp-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, target)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise


def changes(current: DataFrame, mutation: DataFrame) -> DataFrame:
    """What a mutation (path, op, content) would do to ``current`` (path, raw): (path, op, content, effect).

    ``op`` is write or delete; ``effect`` is written, removed, or unchanged for equal content and absent files.
    """
    there = current.select("path", F.col("raw").alias("before"), F.lit(True).alias("was"))
    both = mutation.join(there, "path", "left")
    write = F.when(F.col("was") & F.col("content").eqNullSafe(F.col("before")), "unchanged").otherwise("written")
    return both.select("path", "op", "content", F.when(F.col("op") == "write", write).when(F.col("was"), "removed").otherwise("unchanged").alias("effect"))


def apply(root: str | Path, current: DataFrame, mutation: DataFrame) -> dict[str, int]:
    """Writes the effective changes below ``root`` and counts the effects; an invalid path raises ValueError."""
    all_ = changes(current, mutation)
    counts = {"written": 0, "removed": 0, "unchanged": 0} | {r.effect: r.n for r in all_.groupBy("effect").agg(F.count("*").alias("n")).collect()}
    effective = all_.filter("effect <> 'unchanged'").withColumn("ok", rel_path("path").eqNullSafe(F.col("path")))
    for r in effective.toLocalIterator():
        if not r.ok:
            raise ValueError(f"{r.path!r} is no path of a corpus")
        if r.op == "write":
            write_file(Path(root), r.path, r.content)
        else:
            (Path(root) / r.path).unlink(missing_ok=True)
    return counts


def import_files(root: str | Path, current: DataFrame, files: DataFrame) -> dict[str, int]:
    """Writes all of ``files`` (path, raw), as ``corpus.scan`` or ``corpus.scan_zip`` gives them, that differ below ``root``."""
    return apply(root, current, files.select("path", F.lit("write").alias("op"), F.col("raw").alias("content")))


def export_zip(files: DataFrame, target: str | Path) -> int:
    """All files as one archive in order of their paths; returns their number."""
    n = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for r in files.select("path", "raw").orderBy("path").toLocalIterator():
            z.writestr(r.path, r.raw)
            n += 1
    return n


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def sarif(checks: DataFrame) -> DataFrame:
    """Diagnostics as SARIF results: (path, result); passes are left out."""
    level = F.when(F.col("level") == "err", "error").when(F.col("level") == "warn", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    result = F.struct(F.col("code").alias("ruleId"), level.alias("level"), F.struct(F.col("msg").alias("text")).alias("message"), F.array(place).alias("locations"))
    return checks.filter("level <> 'pass'").select("path", F.to_json(result).alias("result"))


def write_sarif(checks: DataFrame, target: str | Path, tool: str = "cartulary") -> int:
    """A SARIF 2.1.0 file, written row by row in order of paths; returns the number of results."""
    n = 0
    head = {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"}
    with open(target, "w", encoding="utf-8") as f:
        f.write(json.dumps(head)[:-1] + ', "runs": [{"tool": ' + json.dumps({"driver": {"name": tool, "rules": []}}) + ', "results": [')
        for r in sarif(checks).orderBy("path", "result").toLocalIterator():
            f.write((",\n" if n else "\n") + r.result)
            n += 1
        f.write("\n]}]}\n")
    return n


def report(checks: DataFrame, notes: int, block_warnings: bool = False) -> str:
    """Errors and warnings in order of paths, a line each, and a line of numbers; for people to read."""
    from cartulary.operators.checks import summary

    s = summary(checks).first()
    mark = F.when(F.col("level") == "err", "✗").otherwise("!")
    rows = checks.filter("level IN ('err', 'warn')").select("path", "code", F.format_string("  %s [%s] %s: %s", mark, "code", "path", "msg").alias("line"))
    lines = [r.line for r in rows.orderBy("path", "code", "line").toLocalIterator()]
    verdict = "doesn't conform" if s.errors else "doesn't conform (warnings block)" if block_warnings and s.warnings else "conforms"
    return "\n".join([*lines, "", f"{notes} notes · {s.errors} errors · {s.warnings} warnings · {verdict}"])


def write_analysis(checks: DataFrame, concepts: DataFrame, links: DataFrame, orphans: DataFrame, dangling: DataFrame, target: str | Path) -> None:
    """The analysis of a corpus as one JSON document, written row by row: notes, links, orphans, dangling links and
    diagnostics, the numbers of errors and warnings, and whether it conforms."""
    from cartulary.operators.checks import hard_fail, summary

    s, h = summary(checks).first(), hard_fail(checks).first()
    head = {"conformant": s.errors == 0, "hardFail": h.hard_fail, "errors": s.errors, "warnings": s.warnings, "infos": s.infos}
    parts = {
        "concepts": concepts.select("path"), "links": links.select("src", "dst"), "orphans": orphans.select("path"), "dangling": dangling.select("src", "dst"),
        "diagnostics": checks.filter("level <> 'pass'").select("path", "level", "code", "msg"),
    }
    with open(target, "w", encoding="utf-8") as f:
        f.write(json.dumps(head)[:-1])
        for name, df in parts.items():
            f.write(f', "{name}": [')
            for i, r in enumerate(as_json(df.distinct().orderBy(*df.columns)).toLocalIterator()):
                f.write((",\n" if i else "\n") + r.json)
            f.write("]")
        f.write("}\n")


def append_json(df: DataFrame, folder: str) -> None:
    """Rows appended to a JSON table (audits, receipts)."""
    df.write.mode("append").json(folder)


def audit(root: str | Path, record: dict) -> bool:
    """One line appended to the audit log of a workspace; where that fails nothing else does."""
    try:
        folder = Path(root, ".cartulary/runtime")
        folder.mkdir(parents=True, exist_ok=True)
        with open(folder / "audit.jsonl", "a", encoding="utf-8") as f:
            f.write(json.dumps(record, ensure_ascii=False) + "\n")
        return True
    except OSError:
        return False


def ignore(root: str | Path, lines: list[str]) -> bool:
    """Adds lines to the root's ignore file that it lacks; whether it was written. All else in it stays."""
    path = Path(root, ".gitignore")
    there = path.read_text(encoding="utf-8").splitlines() if path.is_file() else []
    new = [x for x in lines if x not in (t.strip() for t in there)]
    if new:
        path.write_text("\n".join([*there, *new]) + "\n", encoding="utf-8")
    return bool(new)
