"""Registered queries against DuckDB on the small tables."""

import os

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the small tables are not there")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.plans.QUERIES))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SMALL)
    if name not in __spark_entry__.oracle_sql():
        assert df.count() > 0
        return
    want = duck.sql(__spark_entry__.oracle_sql()[name]).df()
    got = df.toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda p: sorted(map(str, p[columns].astype(object).where(p[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
