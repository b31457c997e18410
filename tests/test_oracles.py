"""Registered queries against their SQL oracles on the smallest scale factor."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from sparsegrad.plans.catalog import QUERIES

TABLES = ["orders", "lineitem", "embeddings"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    fmt = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
    return sorted(tuple(fmt(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, sf, name):
    df = queries()[name](spark, sf)
    res = con.execute(oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _canon(df.columns, [tuple(r) for r in df.collect()]) == _canon(ocols, res.fetchall())


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0 and df.columns == ["idx", "w"]
