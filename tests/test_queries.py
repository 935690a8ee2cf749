"""Every query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from loomspark.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: round(v, 5) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = plain(map(tuple, got.collect()), got.columns), plain(want.fetchall(), names)
    assert a and a == b


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_obtain_tree_full_same_as_brute_force(spark):
    at = SF.replace("sf0.01", "sf0.001")
    con = duckdb.connect()
    edges = con.execute(f"select distinct c_nationkey, s_nationkey from '{at}/lineitem.parquet' join '{at}/orders.parquet' on l_orderkey = o_orderkey join '{at}/customer.parquet' on o_custkey = c_custkey join '{at}/supplier.parquet' on l_suppkey = s_suppkey").fetchall()
    to = {}
    for s, d in edges:
        to.setdefault(s, []).append(d)
    want, ways = [], [((s,), False) for s in to]
    while ways:
        way, again = ways.pop()
        depth = len(way) - 1
        stub = "repeat" if again else "expandable" if depth == 4 and way[-1] in to else None
        want.append((way[0], way[-1], depth, ">".join(map(str, way)), stub))
        if not again and depth < 4:
            ways += [((*way, d), d in way) for d in to.get(way[-1], ())]
    got = queries.QUERIES["obtain_tree_full"](spark, at).select("root", "node", "depth", "path", "stub")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {r[2] for r in want} == {0, 1, 2, 3, 4}
