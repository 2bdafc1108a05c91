"""The corpus queries that have SQL against it, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tramline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = c.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]}) x").fetchall()
    assert len(want) and sorted(map(str, map(tuple, df.select(cols).collect()))) == sorted(map(str, want))
