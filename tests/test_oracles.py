"""Registered queries against their DuckDB oracles on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, "" if x is None else x) for x in r))


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert got, "an empty answer proves nothing"
    assert ordered(got) == ordered(want.project(",".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert rows and set(driver.oracle_sql()) <= set(driver.queries())
