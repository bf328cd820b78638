"""Headings and sections of Markdown bodies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_I = IntegerType()
HEADINGS = ArrayType(
    StructType([StructField("level", _I), StructField("title", StringType()), StructField("line", _I), StructField("start", _I), StructField("content", _I), StructField("end", _I)])
)


def headings(body: str) -> list[dict]:
    """Headings outside of fences with their lines from 0, where they start, and the range [content, end) of characters
    below them.

    A heading is one to six ``#`` at the beginning of a line before a blank or tab; its title is all that follows. A
    section ends where the next heading of the same or a higher level begins.
    """
    out, at, fenced = [], 0, False
    for no, line in enumerate(body.split("\n")):
        size = len(line) + 1
        line = line.rstrip("\r")
        level = len(line) - len(line.lstrip("#"))
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced and 1 <= level <= 6 and line[level : level + 1] in (" ", "\t") and len(line) > level:
            out.append({"level": level, "title": line[level:].strip(), "line": no, "start": at, "content": min(at + size, len(body)), "end": len(body)})
        at += size
    open_: list[dict] = []
    for h in out:
        while open_ and open_[-1]["level"] >= h["level"]:
            open_.pop()["end"] = h["start"]
        open_.append(h)
    return out


def section(body: str, path: list[str]) -> tuple[int, int] | None:
    """Range of what stands below the heading named by a path of titles, each looked for within the one before."""
    start, end, own = 0, len(body), headings(body)
    for title in path:
        found = next((h for h in own if h["title"] == title and start <= h["start"] < end), None)
        if found is None:
            return None
        start, end = found["content"], found["end"]
    return (start, end) if path else None


@pandas_udf(HEADINGS)
def parse_headings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda b: headings(b or ""))


def extract_sections(body: Column, paths: list[list[str]]) -> Column:
    """What stands in the named sections, joined by blank lines; sections that aren't there are passed over."""

    @pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(b: str | None) -> str:
            found = [section(b or "", p) for p in paths]
            return "\n\n".join((b or "")[x[0] : x[1]] for x in found if x)

        for s in batches:
            yield s.map(one)

    return run(F.coalesce(body, F.lit("")))
