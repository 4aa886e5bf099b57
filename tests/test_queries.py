"""Each query against its SQL in DuckDB, at the smallest scale."""

import glob

import duckdb
import pytest

from strandloom.plans import catalog
from strandloom.plans.dialect import duckdb_sql, spark_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rpartition('/')[2][:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    want = sorted(duck.sql(catalog.oracle_sql()[name]).project(", ".join(columns)).fetchall(), key=str)
    assert got == want


def test_macros():
    assert spark_sql("SELECT RANGE(0; f(g(x)) - 1) AS i") == "SELECT explode(CASE WHEN f(g(x)) - 1 >= 0 THEN sequence(CAST(0 AS BIGINT), CAST(f(g(x)) - 1 AS BIGINT)) ELSE CAST(array() AS ARRAY<BIGINT>) END) AS i"
    assert duckdb_sql("LETTERS(t, 'a', '';ALL)") == "regexp_replace(t, 'a', '', 'g')"
