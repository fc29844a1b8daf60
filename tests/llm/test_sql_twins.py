"""The queries that SQL can express agree with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tidewin.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(set(Q.ORACLES) - {"chat_call_order", "op1_sharding", "op2_quality_rules", "op5_chat"}))  # those: test_against_plain.py
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations", "lineitem"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(Q.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [list(found.columns).index(c) for c in columns]
    key = lambda r: [(v is None, str(v)) for v in r]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert got == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=key) and got
