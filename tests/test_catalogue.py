"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import glob
import os

import pytest

from keystrand.plans import catalogue, engine  # noqa: F401  engine registers queries with the catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    got = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(got.fetchall(), columns)


def test_key_predicates_reach_the_scan(spark):
    plan = catalogue.prefix_scan(spark, DIR)._jdf.queryExecution().toString()
    assert "StringStartsWith(p_name,cold)" in plan
    plan = catalogue.range_sum(spark, DIR)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderkey,1000)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
