"""Every query with SQL against that SQL, on the smallest tables, and the entry contract."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(df):
    def cell(x):
        if x is None or x != x:
            return None
        return round(float(x), 6) if isinstance(x, float) else tuple(map(cell, x)) if isinstance(x, list) else x

    return sorted((tuple(cell(x) for x in r) for r in df), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    found = entry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    told = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})")
    assert sorted(told.columns) == columns
    assert rows(found.select(*columns).collect()) == rows(told.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
