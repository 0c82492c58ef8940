"""The pN_found queries with SQL against DuckDB, all of them for their columns, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from brindle.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, name):
    df = queries.queries()[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted(map(str, df.select(*columns).collect()))
    assert len(rows) == len(set(rows))
    if sql := oracle.oracle_sql().get(name):
        c = duckdb.connect()
        for f in glob.glob(f"{data}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        normal = lambda rs: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rs)
        assert normal(df.select(*columns).collect()) == normal(c.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


def test_columns(spark, data):
    want = {
        "p1_found": [("id_a", "string"), ("id_b", "string")], "p2_found": [("id_a", "string"), ("id_b", "string")], "p3_found": [("id_a", "string"), ("id_b", "string")],
        "p4_found": [("id", "string"), ("term", "string")], "p5_found": [("query_id", "bigint"), ("id", "string")], "p6_found": [("doc_id", "bigint"), ("item_id", "bigint")],
        "p7_found": [("source", "string")], "p8_found": [("doc_a", "bigint"), ("doc_b", "bigint")],
    }
    for name, columns in want.items():
        assert queries.queries()[name](spark, data).dtypes == columns
