"""Every query with SQL agrees with DuckDB on the smallest tables, if they are there."""

import collections
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if isinstance(v, bool):
        return v
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    r = duck.execute(entry.oracle_sql()[name])
    there = [d[0] for d in r.description]
    assert sorted(there) == columns
    want = collections.Counter(tuple(norm(row[there.index(c)]) for c in columns) for row in r.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
