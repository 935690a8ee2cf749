from __future__ import annotations

import re

import numpy as np
import pytest

from loomspark.llm import near_dup

from . import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sets(rows, size):
    for i, t, *_ in rows:
        w = WORD.findall(lower(t))
        k = min(size, len(w))
        yield i, {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()


def brute(rows, size=2, percent=80):
    found = list(sets(rows, size))
    up = list(range(len(found)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(found)):
        for b in range(a):
            x, y = found[a][1], found[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[root(a)] = root(b)
    groups = {}
    for a, (i, _) in enumerate(found):
        groups.setdefault(root(a), []).append(i)
    for a, (i, s) in enumerate(found):
        known = [x for x in groups[root(a)] if x is not None]
        smallest = min(known) if known else None
        yield i, len(s), smallest, i == smallest


def key(r):
    return (r[0] is not None, r[0] or 0)


@pytest.mark.parametrize("seed", [1, 5])
def test_same_as_all_pairs(spark, seed):
    got = near_dup.near_duplicates(data.table(spark, seed, extra=True), size=2).select("id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(data.rows(seed)), key=key)


def test_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = near_dup.near_duplicates(docs, size=2).select("id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_keep_one(spark):
    docs = data.table(spark, extra=True)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c, k in brute(data.rows(), 5) if k}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)  # each once, though rows of the table repeat
    assert near_dup.keep_one(docs.limit(0)).count() == 0


def test_keep_one_of_repeated_rows_and_null_ids(spark):
    t = " ".join(f"word{i}" for i in range(60))
    near = t.replace("word30", "other")
    alone = t.replace("word", "else")
    rows = [(1, t), (1, t), (None, near), (None, near), (None, alone), (None, alone), (None, alone + " more"), (None, None), (None, None), (2, ""), (3, "")]
    got = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:5], r.text is None) for r in got) == [(0, "", True), (0, "else0", False), (1, "word0", False), (2, "", False), (3, "", False)]


def test_collision_corrected_estimate():
    r = np.random.RandomState(1)
    both, a, b = (r.randint(0, 1 << 62, n, dtype=np.uint64) for n in (2000, 500, 500))
    with np.errstate(over="ignore"):
        x, y = near_dup.registers(np.concatenate([both, a]), 2048), near_dup.registers(np.concatenate([both, b]), 2048)
    assert abs(near_dup.estimate((x == y).sum(), 2048) - 2000 / 3000) < 0.05
