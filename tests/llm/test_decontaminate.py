from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from loomspark.llm import decontaminate

from . import data

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def items_of(rows):
    long = [t for _, t, *_ in rows if t and len(t) > 300]
    a = long[3].split()
    return [(1, " ".join(a[5:30]).upper()), (2, "Changed changed!"), (3, None), (4, ""), (5, "..."), (6, "ONE two"), (7, " ".join(a[5:30])), (8, "é, ü"), (9, "nowhere found"), (10, " ".join(a[:9]))]


def brute(rows, items, size=10):
    for i, t, *_ in rows:
        w, hit, found = words_of(t), set(), set()
        for item, text in items:
            x = words_of(text)
            k = min(size, len(x))
            wins = {tuple(x[a : a + k]) for a in range(len(x) - k + 1)} if x else set()
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in wins:
                    hit.update(range(a, a + k))
                    found.add(str(item))
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def key(r):
    return (r[0] is not None, r[0] or 0)


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_same_as_all_windows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    rows = data.rows()
    bench = spark.createDataFrame(items_of(rows), "item_id long, text string")
    got = decontaminate.scan(data.table(spark, extra=True), bench).drop("key")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, items_of(rows)), key=key)
    clean = decontaminate.remove_documents(data.table(spark, extra=True), bench)
    assert clean.columns == data.table(spark, extra=True).columns
    assert clean.count() == sum(not r[-1] for r in brute(rows, items_of(rows)))
    spans = decontaminate.remove_spans(data.table(spark), bench)
    assert spans.count() == len(rows)
    assert not decontaminate.scan(spans, bench.where("item_id in (1, 7)")).where("contaminated").count()


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(data.table(spark), bench).where("contaminated").count() == 0
    assert decontaminate.scan(data.table(spark).where(F.lit(False)), bench).count() == 0
