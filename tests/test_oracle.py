"""Every query with oracle SQL returns what DuckDB returns."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from millrace.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    show = lambda v: None if v is None or (isinstance(v, float) and v != v) or v is pd.NaT else (bool(v) if isinstance(v, bool) else v)
    return sorted((tuple(str(show(v)) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    ints = lambda f: f.apply(lambda c: c.astype("Int64") if pd.api.types.is_numeric_dtype(c) and not pd.api.types.is_bool_dtype(c) and (c.dropna() == c.dropna().round()).all() else c)
    assert rows(ints(got)) == rows(ints(want))
    assert len(got) > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
