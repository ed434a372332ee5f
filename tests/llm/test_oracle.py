"""Queries with SQL return what DuckDB returns."""

import glob
import os

import duckdb
import pytest

from millrace.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = queries.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name].strip()})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) and want
