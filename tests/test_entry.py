"""Registered queries run, have stable names and agree with their SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ruleweave.plans import catalogue


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["o_orderkey", "o_totalprice", "threshold"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(frame):
    return sorted(tuple(None if v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, small, tables, name):
    got, want = catalogue.QUERIES[name](spark, small).toPandas(), tables.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0
