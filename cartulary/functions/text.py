"""Parts and properties of raw Markdown texts, as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The patterns of the text format, in Java's dialect ((?U): white space and digits of any script).
FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"
LINK = r'(?U)\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)'
CONFLICT = r"(?m)^(<{7}|={7}|>{7}|\|{7})"
HEADING = r"(?mU)^#{1,6}\s"
VERSION_LINE = r"(?U)^\s*okf_version\s*:"
LOG_HEADING = r"(?md)^##\s+(.+)$"
LOG_DATE = r"^##\s+\d{4}-\d{2}-\d{2}\s*$"
ISO = r"^(\d{4})-(\d{2})-(\d{2})([T ](\d{2}):(\d{2})(:(\d{2})(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?\z"


def front_text(raw: Column) -> Column:
    """Text of the front matter: '' without one, null if it isn't closed."""
    return F.when(~raw.startswith("---"), F.lit("")).when(raw.rlike(FRONT), F.regexp_extract(raw, FRONT, 1))


def body_text(raw: Column) -> Column:
    return F.when(raw.startswith("---") & raw.rlike(FRONT), F.regexp_extract(raw, FRONT, 2)).otherwise(raw)


def hrefs(body: Column) -> Column:
    """Targets of all Markdown links as written, in order."""
    return F.regexp_extract_all(body, F.lit(LINK), F.lit(1))


def relative_hrefs(body: Column) -> Column:
    return F.filter(hrefs(body), lambda h: h.rlike(r"^\.{1,2}/") & h.contains(".md"))


def is_iso(value: Column) -> Column:
    """Whether a text is an ISO date or time, by its letters only (31 February and hour 24 pass)."""
    part = lambda i: F.try_to_number(F.nullif(F.regexp_extract(value, ISO, i), F.lit("")), F.lit("9999"))
    day = part(1).between(1, 9999) & part(2).between(1, 12) & part(3).between(1, 31)
    time = part(5).isNull() | ((part(5) <= 24) & (part(6) <= 59) & (F.coalesce(part(8), F.lit(0)) <= 59))
    return F.coalesce(value.rlike(ISO) & day & time, F.lit(False))


def occurrences(text: Column, needle: str) -> Column:
    """How often a lower-case needle stands in the text, without overlap; 1 at least (also for an empty needle)."""
    if not needle:
        return F.lit(1.0)
    low = F.lower(text)
    n = (F.length(low) - F.length(F.replace(low, F.lit(needle), F.lit("")))) / F.lit(len(needle))
    return F.greatest(F.coalesce(F.round(n), F.lit(0.0)), F.lit(1.0)).cast("double")


def snippet(body: Column, needle: str, window: int = 160, lead: int = 30) -> Column:
    """A window around the first place of a lower-case needle, white space collapsed, dots where text is left out."""
    flat = F.trim(F.regexp_replace(body, r"(?U)\s+", " "))
    at = F.locate(needle, F.lower(flat)) - 1 if needle else F.lit(-1)
    start = F.when(at < 0, 0).otherwise(F.greatest(at - lead, F.lit(0)))
    cut = F.substr(flat, start + 1, F.lit(window))
    before = F.when(start > 0, "…").otherwise("")
    after = F.when(start + window < F.length(flat), "…").otherwise("")
    return F.concat(before, cut, after)


@pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Form NFC; only values beyond ASCII go through Python."""
    odd = c.rlike(r"[^\x00-\x7F]")
    return F.when(odd, _nfc(F.when(odd, c))).otherwise(c)


def slug(tag: Column) -> Column:
    """A tag as a name of a folder; ``tag`` if nothing is left."""
    s = nfc(F.regexp_replace(F.lower(tag), r"(?U)^\s+|\s+$", ""))
    for pattern in (r"[/\\'\"]+", r"(?U)\s+", r"[^\p{L}\p{N}._-]+", "-+"):
        s = F.regexp_replace(s, pattern, "-")
    s = F.regexp_replace(s, r"^[-.]+|[-.]+$", "")
    return F.when(s == "", "tag").otherwise(s)


def field_line(raw: Column, field: str) -> Column:
    """Number of the line, from 1, where ``field:`` stands in the front matter; null if it doesn't."""
    lines = F.split(front_text(raw), "\n")
    first = F.array_position(F.transform(lines, lambda x: F.startswith(F.ltrim(x), F.lit(f"{field}:"))), True)
    return F.when(first > 0, (first + 1).cast("int"))


def version(raw: Column) -> Column:
    """The format's version in the front matter of the root index; null without one."""
    return F.nullif(F.regexp_extract(raw, r"(?m)^okf_version:\s*[\"']?([^\"'\s]+)", 1), F.lit(""))


def natural_key(path: Column) -> Column:
    """A key by which numbers within names sort by value: runs of digits padded and led by their length."""
    runs = F.regexp_extract_all(F.lower(path), F.lit(r"(?s)\d+|\D+"), F.lit(0))
    digits = lambda r: F.regexp_replace(r, "^0+(?=.)", "")
    pad = lambda r: F.concat(F.lpad(F.length(digits(r)).cast("string"), 6, "0"), digits(r))
    return F.concat(F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), pad(r)).otherwise(r)), ""), F.lit("\x00"), path)
