"""Registered queries against their SQL at the smallest scale."""

import math

import pytest

import __spark_entry__ as entry
from docquarry import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


def same(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert a == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n in entry.oracle_sql()])
def test_same_as_sql(spark, duck, name):
    same(spark, duck, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
