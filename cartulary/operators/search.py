"""A small search language as one column predicate, with filters, scores, snippets and pages."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions import paths as P
from cartulary.functions import text as T


@dataclass(frozen=True)
class Token:
    """One term: ``field`` None for loose text; ``exact`` for ``=``."""

    field: str | None
    value: str
    exact: bool = False
    negated: bool = False


_TERM = re.compile(r'(?s)(?:(?P<field>[A-Za-z0-9_-]*)(?P<op>[:=]))?(?:"(?P<quoted>[^"]*)"?|(?P<plain>\S*))')


def tokenize(query: str) -> list[Token]:
    """Terms between white space; ``-`` before a term and ``!`` before a value negate; values may be quoted.

    A field is a run of ASCII letters, digits, ``_`` and ``-`` before ``:`` (part of the value) or ``=`` (all of it); an
    empty field is loose text.
    """
    out, i, n = [], 0, len(query)
    while True:
        while i < n and query[i].isspace():
            i += 1
        if i == n:
            return out
        negated = query[i] == "-"
        term = _TERM.match(query, i + negated)
        quoted, plain = term["quoted"], term["plain"]
        value = plain if quoted is None else quoted
        if value.startswith("!"):
            negated, value = not negated, value[1:]
        out.append(Token(term["field"] or None, value, term["op"] == "=", negated))
        i = term.end()


def _named(key: str) -> Column:
    """The pair of a key as written, else of its lower-case form."""
    own = lambda k: F.get(F.filter("pairs", lambda p: p["key"] == k), F.lit(0))
    return F.coalesce(own(key), own(key.lower()))


def _present(key: str) -> Column:
    p = _named(key)
    empty = ((p["tag"] == "str") & (p["scalar"] == "")) | ((p["tag"] == "list") & (F.size(p["items"]) == 0))
    return p.isNotNull() & ~F.coalesce(empty, F.lit(False))


def _values(p: Column) -> Column:
    return F.when(p["tag"] == "list", p["items"]).otherwise(F.array(p["scalar"]))


def _field(key: str, value: str, exact: bool) -> Column:
    low = value.lower()
    p = _named(key)
    hit = lambda x: (F.lower(x) == low) if exact else F.contains(F.lower(x), F.lit(low))
    return F.when(p.isNotNull(), F.exists(_values(p), hit)).otherwise(False)


def loose(value: str) -> Column:
    """Part of the file's name, of any value of the front matter or of the body, without regard to case."""
    low = F.lit(value.lower())
    own = F.exists("pairs", lambda p: (p["tag"] != "null") & F.exists(_values(p), lambda x: F.contains(F.lower(x), low)))
    return F.contains(F.lower(P.basename("path")), low) | F.coalesce(own, F.lit(False)) | F.contains(F.lower("body"), low)


#: Statuses that ``is:`` knows.
STATUSES = ("accepted", "draft", "review", "deprecated")
#: ``is:`` terms that need a flag column of the same name.
FLAGS = ("orphan", "invalid", "linked")


def _is(value: str) -> Column:
    if value in FLAGS:
        return F.coalesce(F.col(value), F.lit(False))
    if value == "reserved":
        return F.col("kind") != "concept"
    if value in STATUSES:
        return F.coalesce(F.lower("status") == value, F.lit(False))
    return F.lit(False)


def predicate(query: str) -> Column:
    """All terms of a query as one condition on parsed notes; an empty query holds for every note.

    On index and log pages terms on fields are false, negated or not; ``body:`` and loose text apply to them.
    """

    def one(t: Token) -> Column:
        field = (t.field or "").lower()
        gated = False
        if not t.field:
            c = loose(t.value)
        elif field in ("has", "no"):
            c, gated = _present(t.value), True
            c = ~c if field == "no" else c
        elif field == "is":
            c, gated = _is(t.value.lower()), t.value.lower() != "reserved"
        elif field == "body":
            c = F.contains(F.lower("body"), F.lit(t.value.lower()))
        else:
            c, gated = _field(t.field, t.value, t.exact), True
        c = F.coalesce(c, F.lit(False))
        c = ~c if t.negated else c
        return (F.col("kind") == "concept") & c if gated else c

    return reduce(lambda a, b: a & b, map(one, tokenize(query)), F.lit(True))


def flags(query: str) -> set[str]:
    """Flag columns that a query needs; only these are joined."""
    return {t.value.lower() for t in tokenize(query) if (t.field or "").lower() == "is" and t.value.lower() in FLAGS}


def select(parsed: DataFrame, query: str, **flag_tables: DataFrame) -> DataFrame:
    """Parsed files that a query holds for; ``flag_tables`` gives the paths of each flag."""
    for f in flags(query):
        own = flag_tables[f].select("path").distinct().withColumn(f, F.lit(True))
        parsed = parsed.join(own, "path", "left")
    return parsed.filter(predicate(query))


def narrowed(parsed: DataFrame, types: list[str] = (), statuses: list[str] = (), tags: list[str] = (), prefix: str = "") -> DataFrame:
    """Filters beside the query, without regard to case but for the prefix."""
    low = lambda xs: [x.lower() for x in xs]
    if types:
        parsed = parsed.filter(F.lower("type").isin(low(types)))
    if statuses:
        parsed = parsed.filter(F.lower("status").isin(low(statuses)))
    if tags:
        own = F.transform(_values(_named("tags")), F.lower)
        parsed = parsed.filter(F.arrays_overlap(own, F.array(*map(F.lit, low(tags)))))
    return parsed.filter(F.col("path").startswith(prefix)) if prefix else parsed


def ranked(parsed: DataFrame, query: str) -> DataFrame:
    """Hits with score and snippet: (path, title, score, snippet). The whole query is the text that is counted."""
    needle = query.strip().lower()
    title = F.coalesce(F.nullif("title", F.lit("")), P.title_from_path("path"))
    return parsed.select("path", title.alias("title"), T.occurrences(F.col("raw"), needle).alias("score"), T.snippet(F.col("body"), needle).alias("snippet"))


def page(hits: DataFrame, limit: int = 20, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """One page by score and path, at most 100 rows, and the next cursor if more may follow.

    Spark keeps the first rows of each partition (no full sort). A malformed cursor is the beginning.
    """
    offset, limit = offset_of(cursor), max(0, min(limit, 100))
    rows = hits.orderBy(F.desc("score"), "path").offset(offset).limit(limit)
    return rows, (cursor_of(offset + limit) if limit else None)


def cursor_of(offset: int) -> str:
    return str(offset).encode().hex()


def offset_of(cursor: str | None) -> int:
    try:
        return max(0, int(bytes.fromhex(cursor or "").decode() or 0))
    except ValueError:
        return 0


def inverted_index(parsed: DataFrame) -> DataFrame:
    """(term, path, n): words of each note, an accelerator for whole words; never a filter before part searches."""
    words = F.regexp_extract_all(F.lower("raw"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return parsed.select("path", F.explode(words).alias("term")).groupBy("term", "path").agg(F.count("*").alias("n"))
