"""Every registered query runs on the smallest tables; queries with SQL give its rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fluxgrain.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    if name not in SQL:
        assert got is not None
        return
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"roi", "w1", "w2", "w3"}


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
