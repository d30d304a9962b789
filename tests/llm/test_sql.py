"""The queries with SQL against DuckDB on the smallest tables."""

import glob
import os

import pandas as pd
import pytest
from casefile.llm import queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    return None if pd.isna(v) else v if isinstance(v, str) else round(float(v), 6)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr) for df in (got, want)]
    assert rows[0] == rows[1]


def test_all_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
