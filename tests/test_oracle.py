"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from driftframe import case_queries, nested_queries, oracle, perturbed

SF = "/root/testdata/sf0.001"
QUERIES = {n: perturbed.runner(s) for n, s in perturbed.SPECS.items()} | nested_queries.QUERIES | case_queries.QUERIES
SQL = {n: oracle.write(s) for n, s in perturbed.SPECS.items()} | nested_queries.SQL | case_queries.SQL


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, tables, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = tables.sql(SQL[name])
    assert sorted(want.columns) == columns
    key = lambda r: tuple(map(str, r))
    mine = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    theirs = sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=key)
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
