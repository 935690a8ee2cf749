"""The registered queries against their SQL, on the driver's tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from loomspark.llm import queries

SF = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = sorted(map(tuple, got.select(*names).collect())), sorted(want.fetchall())
    assert a and a == b
