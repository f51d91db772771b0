"""Every registered query against its oracle SQL on the smallest tables."""

import os

import duckdb
import pytest

from bibspark.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def rows(columns, data):
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in data)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
