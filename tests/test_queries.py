"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import code, columns, projects, reports, trees  # noqa: F401  they register with the catalog
from tessera.plans.catalog import ORACLE_SQL, QUERIES

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(AT):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{AT}/{name}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, AT)
    told = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(told.columns) == columns
    place = [told.columns.index(c) for c in columns]
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert mine == sorted((tuple(plain(r[i]) for i in place) for r in told.fetchall()), key=str)
