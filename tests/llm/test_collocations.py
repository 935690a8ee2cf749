from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomspark.llm import collocations

from . import data

LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, most_words, least, cover, top):
    """The definition, phrase by phrase."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, most_words + 1):
                for i in range(len(words) - size + 1):
                    f[lang or "und"][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], a)
        kept = []
        for p, a in candidates.items():
            if 100 * inside[p] >= cover * a:
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def rows(seed: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["Ab", "aB", "c", "dé", "漢字", "e-f", "(g", "h)", " ", "i j", "K"]
    out = [(" ".join(r.choices(words, [9, 5, 4, 3, 3, 2, 2, 2, 1, 1, 1], k=r.randrange(60))) + r.choice(["", ".", "\n", "; x", "\t"]) + " ".join(r.choices(words, k=9)), r.choice(["de", "en", None, "und"])) for _ in range(150)]
    return out + [(None, "de"), ("", None), (" \t", "en"), ("...", "xx"), ("only", "yy"), ("Ab c " * 4000, "en"), ("hot pair " * 3000, "de")] + out[:20]


@pytest.mark.parametrize("size,least,cover,top", [(3, 10, 50, 2000), (3, 2, 50, 25), (2, 3, 90, 40), (4, 4, 40, 30), (5, 3, 60, 500)])
def test_as_defined(spark, size, least, cover, top):
    some = rows(size)
    docs = spark.createDataFrame([(i, t, la, "x", 1) for i, (t, la) in enumerate(some)], data.SCHEMA).repartition(5)
    got = sorted(map(tuple, collocations.collocations(docs, size, least, cover, top).collect()))
    want = plain(some, size, least, cover, top)
    assert got == want and len(want) > 20


def test_shared_cases(spark):
    docs = data.table(spark, extra=True)
    got = sorted(map(tuple, collocations.collocations(docs, least=2).collect()))
    assert got and got == plain([(r[1], r[2]) for r in data.rows()], 3, 2, 50, 2000)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_many_words_need_dense_numbers(monkeypatch):
    """More words than fit a number each: pairs are made dense first."""
    r = random.Random(3)
    words = [f"w{r.randrange(3000)}" for _ in range(30_000)]
    texts = pa.array([" ".join(words).encode()], pa.large_binary())
    want = Counter(zip(*(words[i:] for i in range(6))))  # 3000 ** 6 is beyond 64 bits
    phrases, counts, n = collocations.count_block(texts, 6)
    assert dict(zip(phrases.to_pylist(), counts.tolist())) == {" ".join(k): v for k, v in want.items()} and n == 30_000


def test_texts_do_not_touch():
    texts = pa.array([b"a b", None, b"", b"c. d", b"e"], pa.large_binary())
    assert [collocations.count_block(texts, k)[0].to_pylist() for k in (2, 3)] == [["a b"], []]
    assert collocations.count_block(texts.slice(3), 1)[0].to_pylist() == ["c", "d", "e"]


def test_large_counts_are_exact(spark, monkeypatch):
    """Counts whose products pass 64 bits."""
    a, l, r = 123_456_789_012, 3_123_456_789_012, 987_654_321_987

    def counted(docs, size, text, lang):
        made = {1: [("en", "x", l), ("en", "y", r), ("en", None, l + r)], 2: [("en", "x y", a)], 3: []}
        return spark.createDataFrame(made[size], "lang string, phrase string, f long")

    monkeypatch.setattr(collocations, "phrase_counts", counted)
    assert [tuple(x) for x in collocations.collocations(spark.range(0)).collect()] == [("en", 1, "x y", a, l, r, l + r, 10**6 * a * a // (l * r))]
