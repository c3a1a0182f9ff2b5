"""Every named query against its SQL on DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from check import TABLES, kinds, normal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = con.execute(sql).df()
    a, b = normal(got), normal(want)
    assert list(a.columns) == list(b.columns)
    assert a.equals(b)
    assert kinds(got) == kinds(want)


def test_entry(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 5
