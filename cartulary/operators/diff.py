"""Differences between two states of a corpus: files, fields, lines, links and diagnostics."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from cartulary.functions import text as T

#: Cells of a comparison beyond which lines are compared as one block, and lines kept around a change.
MOST_CELLS, CONTEXT = 2_000_000, 2
#: Order of fields in a report.
FIELDS = ("status", "type", "title", "description", "tags", "timestamp", "resource")
LINES = ArrayType(StructType([StructField("op", StringType()), StructField("text", StringType())]))


def line_diff(a: str, b: str) -> list[tuple[str, str]]:
    """Lines of ``a`` and ``b`` as equal, del and add along a longest common subsequence, lines that are equal as early
    and deletions before additions.

    Rows of the table of lengths are computed at once; an equal head is taken off first. Texts whose table would be
    larger than the guard are all deleted and all added.
    """
    x, y = a.split("\n"), b.split("\n")
    if len(x) * len(y) > MOST_CELLS:
        return [*(("del", t) for t in x), *(("add", t) for t in y)]
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    p, q = x[head:], y[head:]
    mid: list[tuple[str, str]] = []
    number: dict[str, int] = {}
    u, v = (np.array([number.setdefault(t, len(number)) for t in z], np.int64) for z in (p, q))
    best = np.zeros((len(p) + 1, len(q) + 1), np.int32)  # best[i, j]: of what follows i and j
    for i in range(len(p) - 1, -1, -1):
        row = np.maximum(best[i + 1, :-1], best[i + 1, 1:] + (v == u[i]))
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    i = j = 0
    while i < len(p) or j < len(q):
        if i < len(p) and j < len(q) and u[i] == v[j]:
            mid.append(("equal", p[i]))
            i, j = i + 1, j + 1
        elif j == len(q) or (i < len(p) and best[i + 1, j] >= best[i, j + 1]):
            mid.append(("del", p[i]))
            i += 1
        else:
            mid.append(("add", q[j]))
            j += 1
    return [*(("equal", t) for t in x[:head]), *mid]


def collapse(lines: list[tuple[str, str]], context: int = CONTEXT) -> list[tuple[str, str]]:
    """Runs of more than twice ``context`` equal lines become a gap; that many lines stay beside each change, and none at
    the beginning and the end of the text."""
    out: list[tuple[str, str]] = []
    for equal, group in groupby(enumerate(lines), lambda x: x[1][0] == "equal"):
        run = list(group)
        own = [x for _, x in run]
        if equal and len(run) > 2 * context:
            top = context if run[0][0] > 0 else 0
            low = len(run) - (context if run[-1][0] < len(lines) - 1 else 0)
            own = [*own[:top], ("gap", str(low - top)), *own[low:]]
        out += own
    return out


@pandas_udf(LINES)
def _lines(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([[{"op": o, "text": t} for o, t in collapse(line_diff(p or "", q or ""))] for p, q in zip(a, b, strict=True)])


def is_generated(path):
    name = F.element_at(F.split(path, "/"), -1)
    return name.isin("index.md", "log.md") | path.startswith("tags/")


def file_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that differ between (path, raw) states: (path, change, generated, before, after).

    Equal files are dropped by the join's filter, before any text is compared by lines. Generated pages are marked.
    """
    a = before.select("path", F.col("raw").alias("before"), F.lit(True).alias("was"))
    b = after.select("path", F.col("raw").alias("after"), F.lit(True).alias("is"))
    both = a.join(b, "path", "full").filter(F.col("was").isNull() | F.col("is").isNull() | ~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("modified")
    return both.select("path", change.alias("change"), is_generated(F.col("path")).alias("generated"), "before", "after")


def with_lines(diff: DataFrame) -> DataFrame:
    """Line differences between the bodies of files that aren't generated: (path, lines). A file that isn't there has an empty one."""
    body = lambda c: T.body_text(F.coalesce(c, F.lit("")))
    return diff.filter("NOT generated").select("path", _lines(body("before"), body("after")).alias("lines"))


def stats(diff: DataFrame) -> DataFrame:
    """Numbers of changes, generated pages apart: (change, n)."""
    return diff.filter("NOT generated").groupBy("change").agg(F.count("*").alias("n"))


def _fields(parsed: DataFrame) -> DataFrame:
    text = lambda p: F.when(p["tag"] == "list", F.array_join(p["items"], ", ")).otherwise(p["scalar"])
    return parsed.filter("kind = 'concept'").select("path", F.explode("pairs").alias("p")).select("path", F.col("p.key").alias("field"), F.nullif(text(F.col("p")), F.lit("")).alias("v"))


def field_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Fields of notes in both parsed states whose text differs; an absent field is an empty one: (path, field, rank,
    before, after)."""
    both = before.select("path").join(after.select("path"), "path", "left_semi").distinct()
    a, b = _fields(before).withColumnRenamed("v", "before"), _fields(after).withColumnRenamed("v", "after")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field")), F.lit(0)), F.lit(len(FIELDS) + 1))
    differ = a.join(b, ["path", "field"], "full").filter("NOT (before <=> after)").join(both, "path", "left_semi")
    return differ.select("path", "field", rank.cast("int").alias("rank"), F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))


def link_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Links (src, dst) that came or went: (src, dst, change)."""
    a, b = (x.select("src", "dst").distinct() for x in (before, after))
    gone = a.join(b, ["src", "dst"], "left_anti").withColumn("change", F.lit("removed"))
    return b.join(a, ["src", "dst"], "left_anti").withColumn("change", F.lit("added")).unionByName(gone)


def diagnostic_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Diagnostics that came or went, by path, code and message: (path, code, msg, change)."""
    key = ["path", "code", "msg"]
    a, b = (x.filter("level <> 'pass'").select(*key).distinct() for x in (before, after))
    new = b.join(a, key, "left_anti").withColumn("change", F.lit("introduced"))
    return new.unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("resolved")))


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Merge of (path, raw) states: (path, raw, conflict). One side's change wins over no change; two different changes
    of one path come out as one text with conflict marks. Paths that the merge removes are left out."""
    side = lambda df, n: df.select("path", F.col("raw").alias(n))
    all_ = side(base, "b").join(side(ours, "o"), "path", "full").join(side(theirs, "t"), "path", "full")
    o, t, b = F.col("o"), F.col("t"), F.col("b")
    marks = F.concat(F.lit("<<<<<<< ours\n"), F.coalesce(o, F.lit("")), F.lit("=======\n"), F.coalesce(t, F.lit("")), F.lit(">>>>>>> theirs\n"))
    same, by_them, by_us = o.eqNullSafe(t), o.eqNullSafe(b), t.eqNullSafe(b)
    raw = F.when(same | by_us, o).when(by_them, t).otherwise(marks)
    return all_.select("path", raw.alias("raw"), (~(same | by_us | by_them)).alias("conflict")).filter("raw IS NOT NULL")


def semantic(files: DataFrame, fields: DataFrame, links: DataFrame) -> DataFrame:
    """Kinds of change of each file: (path, kind), ``created``, ``modified`` or ``deleted``, and ``frontmatter``, ``body``
    and ``relation`` where these differ. A move comes out as a deletion and a new file."""
    kind = F.when(F.col("change") == "added", "created").when(F.col("change") == "removed", "deleted").otherwise("modified")
    body = lambda c: T.body_text(F.coalesce(c, F.lit("")))
    own = files.filter("NOT generated")
    rows = own.select("path", kind.alias("kind"))
    rows = rows.union(fields.select("path").distinct().withColumn("kind", F.lit("frontmatter")))
    rows = rows.union(own.filter(body("before") != body("after")).select("path", F.lit("body").alias("kind")))
    return rows.union(links.select(F.col("src").alias("path")).distinct().withColumn("kind", F.lit("relation"))).distinct()


def message(files: DataFrame, fields: DataFrame) -> str:
    """One line about a change: the page added, the status set, or the numbers of files. Generated pages don't count."""
    n = {r.change: r.n for r in stats(files).collect()}
    if n == {"added": 1}:
        return f"Add {_title(files.filter((F.col('change') == 'added') & ~F.col('generated')))}"
    status = fields.filter("field = 'status'").limit(2).collect()
    if len(status) == 1 and status[0].after:
        return f"{status[0].after}: {_title(files.filter(F.col('path') == status[0].path))}"
    return f"Update: {n.get('added', 0)} added, {n.get('modified', 0)} modified, {n.get('removed', 0)} removed"


def _title(files: DataFrame) -> str:
    from cartulary.functions.front import parse_files
    from cartulary.functions.paths import title_from_path

    own = parse_files(files.select("path", F.coalesce("after", "before").alias("raw")))
    return own.select(F.coalesce(F.nullif("title", F.lit("")), title_from_path("path"))).first()[0]
