"""Every query with SQL against DuckDB on the smallest tables, and all others for a stable schema."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["link_id", "side", "reason"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 60


def test_rare_terms_are_in_the_full_index(spark, data):
    every = {r.term: (r.notes, r.n) for r in QUERIES["term_index_all"](spark, data).collect()}
    often = {r.term: (r.notes, r.n) for r in QUERIES["term_index"](spark, data).collect()}
    assert any(notes < 20 for notes, _ in every.values()) and often == {t: v for t, v in every.items() if v[0] >= 20}
