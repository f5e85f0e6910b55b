"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return out


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plain(x):
    return float(f"{x:.9g}") if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    order = sorted(got.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == order
    rows = lambda it: sorted((tuple(map(plain, r)) for r in it), key=str)
    assert rows(map(tuple, got.select(order).collect())) == rows(want.select(*[f'"{c}"' for c in order]).fetchall())
