"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from phenospark.jobs import queries as own

SQL = entry.oracle_sql()


def cell(v):
    if v is None or v != v:
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def tables(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return c


@pytest.mark.parametrize("name", [n for n in own.queries() if n in SQL])
def test_query_against_sql(spark, sf, tables, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(map(cell, r)) for r in df.select(*columns).collect()), key=repr)
    want = tables.sql(SQL[name])
    assert sorted(want.columns) == columns
    rows = sorted((tuple(map(cell, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert len(got) == len(rows)
    assert all(all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5 * max(1, abs(b))) for a, b in zip(x, y, strict=True)) for x, y in zip(got, rows, strict=True))


@pytest.mark.parametrize("name", ["outline_polygon", "seg_training_set", "seg_undersample", "cluster_ward", "classify_lda"])
def test_query_without_sql_has_rows(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
