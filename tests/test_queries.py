"""Every registered query against its SQL twin on the smallest tables."""

import os
from collections import Counter

import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(values, columns, wanted):
    at = [columns.index(c) for c in wanted]
    near = lambda v: round(v, 5) if isinstance(v, float) else v
    return Counter(tuple(near(r[i]) for i in at) for r in values)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_twin_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    got = df.collect()
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(got, df.columns, df.columns) == rows(result.fetchall(), columns, df.columns)
