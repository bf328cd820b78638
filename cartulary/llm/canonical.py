"""Mapping hand-typed values to a reference list in SQL: pigeonhole join on segments, checked by edit distance.

If a value is within k edits of an entry, one of k + 1 segments of the entry stands unchanged in the value, shifted by
at most k. Values and entries are joined by equality on (list, substring, its length) with that shift, the few
candidates are measured with the built-in ``levenshtein``, and what finds no entry comes out of an anti-join.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.session import materialize, small_or_not


def _fold(c: str) -> str:
    plain = unicodedata.normalize("NFKD", c)
    return "".join(x for x in "".join(x for x in plain if not unicodedata.combining(x)).lower() if x.isalnum())


@cache
def _folds() -> pd.DataFrame:
    every = [chr(n) for n in range(0x80, sys.maxunicode + 1) if not 0xD800 <= n < 0xE000]
    odd = [c for c in every if unicodedata.normalize("NFKD", c) != c or c.lower() != c]
    rows = [(c, _fold(c)) for c in [*map(chr, range(65, 91)), *odd]]
    return pd.DataFrame(rows, columns=["c", "f"])


def fold_table(spark: SparkSession) -> DataFrame:
    """(c, f): every character that folds to others than itself; fixed by Unicode, below 20,000 rows."""
    return spark.createDataFrame(_folds(), "c string, f string")


#: Values, and entries, with their folded form: NFKD without combining marks, lower case, letters and digits only.
FOLDED = r"""
    SELECT v, regexp_replace(coalesce(listagg(coalesce(f, c), '') WITHIN GROUP (ORDER BY pos), ''), '[^\\p{{L}}\\p{{N}}]', '') AS s
    FROM (SELECT v, posexplode_outer(regexp_extract_all(v, '(?s).', 0)) AS (pos, c) FROM (SELECT DISTINCT v FROM {values} WHERE v IS NOT NULL))
    LEFT JOIN {fold} USING (c)
    GROUP BY v"""

#: The entries' k + 1 segments: (list, entry, e, k, p, l, seg); k is two fifths of the folded length.
SEGMENTS = """
    SELECT list, entry, e, k, p, l, substring(e, p, l) AS seg
    FROM (SELECT list, entry, e, k, i * base + greatest(0, i - (k + 1 - rest)) + 1 AS p,
                 base + if(i >= k + 1 - rest, 1, 0) AS l
          FROM (SELECT list, entry, e, k, length(e) div (k + 1) AS base, length(e) % (k + 1) AS rest, explode(sequence(0, k)) AS i
                FROM (SELECT l.list, l.entry, f.s AS e, cast(length(f.s) * 2 div 5 AS int) AS k
                      FROM (SELECT DISTINCT list, entry FROM {lists} WHERE entry IS NOT NULL) l JOIN {forms} f ON f.v = l.entry)))"""

#: The nearest entry of each (list, value); no row where none is near enough. A list's kinds of segments are their place p
#: and length l with the length n of the entry and its k: a value whose length is within k of n is cut only at the places
#: up to k from p.
NEAREST = """
    WITH kinds AS (SELECT DISTINCT list, length(e) AS n, k, p, l FROM {segments}),
    grams AS (
      SELECT list, v, s, n, p, l, substring(s, at, l) AS seg
      FROM (SELECT w.list, w.v, w.s, t.n, t.p, t.l, explode(if(t.l = 0, array(1),
                   filter(sequence(greatest(1, t.p - t.k), greatest(1, t.p + t.k)), i -> i + t.l - 1 <= length(w.s)))) AS at
            FROM {words} w JOIN kinds t ON t.list = w.list AND abs(t.n - length(w.s)) <= t.k)),
    met AS (
      SELECT DISTINCT g.list, g.v, g.s, t.entry, t.e, t.k
      FROM grams g JOIN {segments} t
        ON t.list = g.list AND length(t.e) = g.n AND t.p = g.p AND t.l = g.l AND t.seg = g.seg),
    measured AS (SELECT list, v, entry, levenshtein(s, e) AS d, k FROM met)
    SELECT list, v, min(struct(d, entry)).entry AS entry FROM measured WHERE d <= k GROUP BY list, v"""

#: Values that are not blank and no entry of their list, with the nearest entry or an empty string.
RESOLVED = """
    SELECT w.list, w.v, n.entry FROM {words} w JOIN {near} n ON n.list = w.list AND n.v = w.v
    UNION ALL
    SELECT w.list, w.v, '' AS entry FROM {words} w LEFT ANTI JOIN {near} n ON n.list = w.list AND n.v = w.v"""

#: Dirty values: neither null, nor blank, nor an entry of a list that has entries.
DIRTY = r"""
    SELECT DISTINCT u.list, u.v, f.s
    FROM {used} u JOIN {forms} f ON f.v = u.v
    LEFT SEMI JOIN {lists} k ON k.list = u.list
    LEFT ANTI JOIN {lists} l ON l.list = u.list AND l.entry = u.v"""

NOT_BLANK = r"NOT {0} RLIKE '(?U)^\\s*$'"


def resolve(used: DataFrame, lists: DataFrame) -> DataFrame:
    """For the dirty ones of (list, v) in ``used``: (list, v, entry), entry '' where none is near enough.

    ``lists`` has (list, entry). A value that is an entry, null or blank, or whose list is empty, gives no row. The
    entry with the fewest edits wins if these are at most 40 % of its folded length; on equal numbers the smaller.
    """
    spark = used.sparkSession
    forms = materialize(spark.sql(FOLDED, values=used.select("v").union(lists.selectExpr("entry AS v")), fold=F.broadcast(fold_table(spark))))
    segments = materialize(spark.sql(SEGMENTS, lists=lists, forms=forms))
    words = materialize(spark.sql(DIRTY, used=used, forms=forms, lists=lists))
    near = materialize(spark.sql(NEAREST, words=words, segments=small_or_not(segments)))
    return materialize(spark.sql(RESOLVED, words=words, near=near))


class NoteValues:
    """``type`` and ``status`` of notes mapped to the document types and their allowed statuses.

    The distinct values are counted out first, so the work follows their number and not the number of notes; the result
    goes back to the notes by a join whose small side has one row a value.
    """

    def __init__(self, files: DataFrame, types: DataFrame):
        spark = files.sparkSession
        self.files, self.spark = files, spark
        names = spark.sql("SELECT '' AS list, name AS entry FROM {t} WHERE name IS NOT NULL", t=types)
        typed = spark.sql("SELECT DISTINCT '' AS list, type AS v FROM {f} WHERE type IS NOT NULL AND " + NOT_BLANK.format("type"), f=files)
        self.types = resolve(typed, names)
        # what each typed value means: itself if it is an entry, else its entry here; '' for none
        self.means = materialize(
            spark.sql(
                "SELECT entry AS v, entry AS name FROM {names} UNION ALL SELECT v, entry FROM {found}",
                names=names.distinct(), found=self.types,
            )
        )
        lists = spark.sql(
            "SELECT DISTINCT * FROM (SELECT name AS list, explode(allowed_statuses) AS entry FROM {t} WHERE name IS NOT NULL"
            " UNION ALL SELECT '' AS list, explode(allowed_statuses) FROM {t}) WHERE entry IS NOT NULL",
            t=types,
        )
        self.noted = spark.sql(
            "SELECT f.path, f.type, f.status, coalesce(m.name, '') AS list FROM {f} f LEFT JOIN {m} m ON m.v = f.type",
            f=files.select("path", "type", "status"), m=small_or_not(self.means),
        )
        used = spark.sql("SELECT DISTINCT list, status AS v FROM {n} WHERE status IS NOT NULL AND " + NOT_BLANK.format("status"), n=self.noted)
        self.statuses = resolve(used, lists)

    def found(self) -> DataFrame:
        """Distinct (path, field, entry) of every value that needed mapping."""
        return self.spark.sql(
            "SELECT DISTINCT * FROM (SELECT n.path, 'type' AS field, t.entry FROM {n} n JOIN {types} t ON t.v = n.type"
            " UNION ALL SELECT n.path, 'status' AS field, s.entry FROM {n} n JOIN {statuses} s ON s.list = n.list AND s.v = n.status)",
            n=self.noted, types=small_or_not(self.types), statuses=small_or_not(self.statuses),
        )

    def unmatched(self) -> DataFrame:
        """Values that mean no entry, with the number of notes: (field, list, value, notes)."""
        return self.spark.sql(
            "SELECT 'type' AS field, '' AS list, n.type AS value, count(DISTINCT n.path) AS notes FROM {n} n"
            " JOIN {types} t ON t.v = n.type AND t.entry = '' GROUP BY n.type"
            " UNION ALL SELECT 'status', n.list, n.status, count(DISTINCT n.path) FROM {n} n"
            " JOIN {statuses} s ON s.list = n.list AND s.v = n.status AND s.entry = '' GROUP BY n.list, n.status",
            n=self.noted, types=small_or_not(self.types), statuses=small_or_not(self.statuses),
        )
