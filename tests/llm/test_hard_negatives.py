from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.llm import hard_negatives

SHAPE = "vec_id long, embedding array<double>, label int, source string"


def plain(rows, every=10, positives=5, negatives=5, least=80, scale=256):
    """The definition: all pairs, in whole numbers."""
    e = [(i, la, [math.floor(scale * x) for x in v]) for i, v, la, *_ in rows if i is not None and la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, la, v in e:
        if i % every or (i, la, tuple(v)) in seen:
            continue
        seen.add((i, la, tuple(v)))
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, lb == la) for j, lb, w in e if j != i))
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            fits = [(t, k) for t, k, own in scored if not own and least * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(i, j, n, k, -s, -t) for n, (t, k) in enumerate(fits, 1)]
    return sorted(out)


def made(seed: int, n: int, width: int, spread: float = 1.0) -> list[tuple]:
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    out = []
    for i in range(n):
        c = r.choice(centres)
        out.append((i, [x + spread * r.gauss(0, 0.3) for x in c], r.randrange(4), "s"))
    return out


def awkward() -> list[tuple]:
    rows = made(1, 120, 5)
    rows += [(200 + i, rows[10][1], i % 3, "s") for i in range(40)]  # ties
    rows += [rows[0], rows[0], rows[10], (20, rows[3][1], 1, "t"), (20, rows[3][1], 2, "t")]  # repeats; one id, other rows
    rows += [(None, rows[1][1], 1, None), (1000, None, 1, None), (1010, rows[1][1], None, None), (1020, [1.0, None, 0.0, 0.0, 0.0], 1, None), (1030, [1.0, math.nan, 0.0, 0.0, 0.0], 1, None), (1040, [math.inf, 0.0, 0.0, 0.0, 0.0], 1, None)]
    rows += [(1050, [], 1, None), (1060, [1.0, 2.0], 2, None), (1070, [-1e-20, 0.0, -0.0, 0.001, -0.001], 3, None), (1080, [0.0] * 5, 3, None), (1090, [-x for x in rows[1][1]], 0, None)]
    rows += [(2000, [4e6] * 5, 9, None), (2001, [4e6, 4e6, 4e6, 4e6, 3999999.99], 9, None), (2002, [3.9e6] * 5, 8, None), (2003, [3.9e6] * 4 + [3900000.004], 8, None), (2010, [0.3] * 5, 77, None)]
    return rows


def same(spark, rows, **sizes):
    df = spark.createDataFrame(rows, SHAPE).select("*", *(F.lit(1).alias(c) for c in ("id", "v", "norm", "qid", "group", "block"))).repartition(4)
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("id") % 10 == 0, **sizes).collect()))
    want = plain(rows, **sizes)
    assert got == want
    return want


@pytest.mark.parametrize("block,queries", [(512, 256), (7, 3)])
def test_awkward_rows(spark, monkeypatch, block, queries):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "QUERIES", queries)
    want = same(spark, awkward())
    assert max(x[4] for x in want) > 1 << 53  # beyond what doubles hold


def test_clusters_and_noise(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    assert len(same(spark, made(2, 400, 8, 0.2))) > 100
    assert same(spark, made(3, 300, 24, 3.0), positives=3, negatives=2, least=50)


def test_intervals_prune_and_radius_grows(spark, monkeypatch):
    """On tight clusters most meetings of queries and blocks never take place, and rows are still all right."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 8)
    monkeypatch.setattr(hard_negatives, "QUERIES", 4)
    rows = made(4, 500, 6, 0.01)
    df = spark.createDataFrame(rows, SHAPE)
    base = hard_negatives.common.written(hard_negatives.prepared(df, "vec_id", "embedding", F.col("label"), 256), "t")
    index = hard_negatives.Index(base)
    ask = base.where("id % 50 = 0").select(F.col("id").cast("string").alias("group"), F.encode(F.col("id").cast("string"), "utf-8").alias("qid"), "id", "label", "v", "norm", F.lit(index.near).alias("r"), F.array(F.lit((1 << 63) - 1)).alias("ceilings"), F.array(F.lit(-(1 << 63))).alias("floors"), F.lit(-1.0).alias("before"))
    seen = []
    meet = hard_negatives.Index.met
    monkeypatch.setattr(hard_negatives.Index, "met", lambda self, q, best, same: (seen.append(q.count()), meet(self, q, best, same))[1])
    found = index.search(ask.drop("before"), 5, True, "t")
    assert found.groupBy("qid").count().where("count < 5").count() == 0
    assert len(seen) >= 2 and seen[0] == 10
    blocks = index.blocks.count()
    narrow = meet(index, ask, 10**6, True).select("qid", "id").distinct().count()
    assert blocks > 50 and narrow < 10 * base.count() / 4 / 2


def test_tables_without_rows_that_take_part(spark):
    df = spark.createDataFrame([(1, None, 1, "s"), (None, [1.0], 1, "s")], SHAPE)
    assert hard_negatives.mine(df, F.col("id") % 10 == 0).count() == 0 == hard_negatives.mine(df.limit(0), F.col("id") % 10 == 0).count()
    assert same(spark, [(i, [], i % 2, "s") for i in range(30)])  # no component at all: all scores are 0
    assert same(spark, [(i, [1.0, 0.5], 1, "s") for i in range(30)]) == []  # one label


def test_products_are_exact():
    a, b = np.array([[3e17, -1.0], [2.0, 5.0]]), np.array([[7e17, 1.0]])
    assert hard_negatives.products(a, b).tolist() == [[int(3e17) * int(7e17) - 1], [2 * int(7e17) + 5]]
    assert hard_negatives.matrix(pa.array([[1.0], [], [2.0, 3.0]]).slice(1), 2).tolist() == [[0, 0], [2, 3]]
