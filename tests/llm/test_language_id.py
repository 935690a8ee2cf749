from __future__ import annotations

import math

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from loomspark.llm import language_id as L

from . import data

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def all_ways(word: str, probs: dict[str, float]) -> float:
    """Sum over all segmentations, one by one."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        p = probs.get(word[:n], 0.0)
        if n == 1:
            p = max(p, L.FLOOR)
        if p:
            total += p * all_ways(word[n:], probs)
    return total


def test_forward_sums_all_segmentations():
    pieces = L.Pieces(VOCABULARY)
    r = np.random.RandomState(3)
    probs = r.rand(len(pieces), 2)
    probs /= probs.sum(0)
    words = ["house", "ünïcode", "x", "漢字", "differentfunction"]
    got = L.Model(VOCABULARY, ("a", "b"), probs).score(words, pieces)
    assert max(map(len, pieces.names)) > 8 and "▁function" in pieces.names
    for i, w in enumerate(words):
        for k in range(2):
            want = math.log(all_ways(L.MARK + w, dict(zip(pieces.names, probs[:, k], strict=True))))
            assert abs(got[i, k] - want) < 1e-9


def test_long_words_are_summed_whole(monkeypatch):
    """The logarithmic way of long words is the multiplied one of short words, and holds where that would underflow."""
    pieces = L.Pieces(VOCABULARY)
    r = np.random.RandomState(4)
    probs = r.rand(len(pieces), 3)
    probs /= probs.sum(0)
    words = ["differentfunctionhouse", "a", "ünïcodefunction", "漢字漢字x"]
    model = L.Model(VOCABULARY, ("a", "b", "c"), probs)
    langs, counts = np.array([0, 1, 2, 1]), np.array([1.0, 2.0, 3.0, 1.0])
    want, uses = model.score(words, pieces), L.expected(words, langs, counts, probs, pieces)
    monkeypatch.setattr(L, "SHORT", 1)
    monkeypatch.setattr(L, "STRETCH", 5)
    assert np.allclose(model.score(words, pieces), want, atol=1e-9)
    assert np.allclose(L.expected(words, langs, counts, probs, pieces), uses, atol=1e-9)
    long = model.score(["function" * 2000], pieces)
    assert np.isfinite(long).all() and (long < -1000).all()


def test_expected_uses_are_those_of_all_segmentations():
    pieces = L.Pieces(VOCABULARY)
    r = np.random.RandomState(5)
    probs = r.rand(len(pieces), 2)
    probs /= probs.sum(0)
    got = L.expected(["house", "ring"], np.array([1, 0]), np.array([3.0, 2.0]), probs, pieces)
    want, number = np.zeros_like(probs), {p: i for i, p in enumerate(pieces.names)}
    for word, k, n in (("house", 1, 3), ("ring", 0, 2)):
        w, ways = L.MARK + word, []

        def cut(at, used, p, w=w, k=k, ways=ways):
            if at == len(w):
                ways.append((p, used))
            for end in range(at + 1, len(w) + 1):
                i = number.get(w[at:end])
                q = 0.0 if i is None else probs[i, k]
                q = max(q, L.FLOOR) if end == at + 1 else q
                if q:
                    cut(end, [*used, i], p * q)

        cut(0, [], 1.0)
        for p, used in ways:
            for i in used:
                if i is not None:
                    want[i, k] += n * p / sum(x for x, _ in ways)
    assert np.allclose(got, want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = L.identify(docs, VOCABULARY).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    right, n = made.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.95


def test_defined_cases(spark):
    got = L.identify(data.table(spark, extra=True), VOCABULARY).collect()
    assert len(got) == len(data.rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t, *_ in data.rows():
        if i is not None:
            assert (by[i].lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))
            assert 0 <= by[i].score <= 1
    none = data.table(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(none, VOCABULARY).collect()} == {"und"}
    assert L.identify(data.table(spark).limit(0), VOCABULARY).count() == 0
    assert {r.doc_id for r in L.keep_known(none, VOCABULARY).collect()} == {i for i, t, *_ in data.rows() if t and any(c.isalpha() for c in t)}
    kept = L.keep_known(data.table(spark, extra=True), VOCABULARY)
    assert kept.columns == data.table(spark, extra=True).columns and kept.count() > 0
