"""Every registered query against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def _key(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return str(value)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    found = entry.queries()[name](spark, SMALL)
    said = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in said.description]
    assert sorted(columns) == sorted(found.columns)
    mine = sorted(tuple(_key(r[c]) for c in columns) for r in found.collect())
    theirs = sorted(tuple(_key(v) for v in r) for r in said.fetchall())
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
