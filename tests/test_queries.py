"""Each query against its SQL on the smallest tables."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from eigenlake.plans.extra_queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def plain(v):
    return round(float(v), 9) if isinstance(v, (float, Decimal)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    q = duck.execute(ORACLES[name])
    have = [x[0] for x in q.description]
    assert sorted(have) == cols
    want = sorted((tuple(plain(r[have.index(c)]) for c in cols) for r in q.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
