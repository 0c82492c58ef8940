"""Every query with SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from brindle import oracle, queries


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def normal(rows):
    return sorted([tuple(repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_as_sql(spark, data, duck, name):
    df = queries.queries()[name](spark, data)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if sql := oracle.oracle_sql().get(name):
        assert normal(rows) == normal(duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


def test_entry(spark, data):
    assert set(oracle.oracle_sql()) <= set(queries.queries())
    assert set(entry.queries()) >= set(queries.queries())
