"""Every registered query that SQL can express, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from fathom.plans import registry

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, str)):
        return v
    return round(float(v), 6) if hasattr(v, "__float__") else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, data, name):
    ours = entry.queries()[name](spark, data)
    columns = sorted(ours.columns)
    theirs = duck.sql(ORACLE[name])
    at = [[x.lower() for x in theirs.columns].index(c.lower()) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in ours.collect()), key=str)
    b = sorted((tuple(plain(r[i]) for i in at) for r in theirs.fetchall()), key=str)
    assert a == b


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).columns


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"qid", "id", "vector_score", "keyword_score", "hybrid_score", "rank"}
