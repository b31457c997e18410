"""Registered queries against their SQL."""

import duckdb
import pytest

from sparsegrad.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str)
