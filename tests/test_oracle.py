"""Every registered query with SQL gives the same rows in DuckDB."""

import glob
import os

import duckdb
import pytest
from check_oracle import compare

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_keys():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert compare(got, duck.execute(ORACLE[name]).df()) == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() == 8
