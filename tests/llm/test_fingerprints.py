from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from loomspark.llm import fingerprints as P

from . import data


def test_homomorphic():
    r = random.Random(1)
    paragraphs = [data.words(r, 20) for _ in range(30)]
    whole = P.Fingerprint.of("\n".join(paragraphs).encode())
    mixed = list(paragraphs)
    r.shuffle(mixed)
    assert P.Fingerprint.of("\n".join(mixed).encode()).text() == whole.text()
    grown = P.Fingerprint.of("\n".join(paragraphs[:-1]).encode()).insert(paragraphs[-1].encode())
    assert grown.text() == whole.text()
    assert whole.delete(paragraphs[3].encode()).text() == P.Fingerprint.of("\n".join(paragraphs[:3] + paragraphs[4:]).encode()).text()
    assert P.likeness(P.Fingerprint.parse(whole.text()), whole) == 1.0


def test_same_as_one_by_one(spark):
    docs = data.table(spark, extra=True)
    for n in (3, 40):
        got = P.compare_with_next(docs, partitions=n).collect()
        digest = lambda t: hashlib.md5(t.encode()).digest() if t is not None else b""
        rows = sorted(((i, t) for i, t, *_ in data.rows()), key=lambda x: (x[0] is not None, x[0] or 0, digest(x[1])))
        want = []
        for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
            t, following = t or "", following or ""
            half = len(t) // 2
            other = t[: len(t) - half] + following[:half]
            a, b, c = (P.Fingerprint.of(x.encode()) for x in (t, other, following))
            want.append((i, len(t), hashlib.sha256(other.encode()).hexdigest(), a.text(), b.text(), P.likeness(a, b), P.likeness(a, c)))
        order = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
        assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert P.compare_with_next(docs.limit(0)).count() == 0
    assert P.compare_with_next(docs.where("doc_id = 20")).first().near_next == 1.0


def test_likeness_tells_edits_from_strangers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 400")
    a, b = P.compare_with_next(docs).selectExpr("avg(near_edited)", "avg(near_next)").first()
    assert a > b + 0.2


def shared(a, b):
    """Share of the two-word shingles of lines that two texts have in common, from all of them."""
    def bag(t):
        out = Counter()
        for line in t.split("\n"):
            w = [x for word in line.split() for x in ([word] if len(word.encode()) <= P.LONG else word)]
            out.update(set(zip(w, w[1:], strict=False)) if len(w) > 1 else set(w))
        return out

    x, y = bag(a), bag(b)
    square = lambda c: sum(n * n for n in c.values())
    return 2 * sum(n * y[k] for k, n in x.items()) / ((square(x) + square(y)) or 1)


def test_wide_lanes_are_sums_of_digests():
    text = "one line\n\nanother line\none line"
    sums = [0] * P.WIDE
    for p in text.encode().split(b"\n"):
        raw = hashlib.shake_128(p).digest(8 * P.WIDE)
        sums = [(s + int.from_bytes(raw[8 * i : 8 * i + 8], "little")) % (1 << 64) for i, s in enumerate(sums)]
    assert P.Fingerprint.of(text.encode()).text().split(":")[0] == b"".join(s.to_bytes(8, "little") for s in sums).hex()


def test_likeness_is_that_of_all_shingles():
    r = random.Random(3)
    of = lambda t: P.Fingerprint.of(t.encode())
    for n in (300, 3000):
        a = data.words(r, n).split()
        for change in (0, 20, 100, 250):
            b = list(a)
            for i in r.sample(range(n), change * n // 300):
                b[i] = f"other{i}"
            x, y = " ".join(a), " ".join(b)
            assert abs(P.likeness(of(x), of(y)) - shared(x, y)) < 0.2
    assert P.likeness(of(data.words(r, 900, 10**9)), of(data.words(r, 900, 10**9))) < 0.25


def test_lanes_do_not_wrap():
    of = lambda n: P.Fingerprint.of(("x " * n).encode())
    for a, b in ((4000, 3000), (40_000, 30_000), (1_000_000, 750_000)):
        assert abs(P.likeness(of(a), of(b)) - shared("x " * a, "x " * b)) < 1e-6
        assert P.likeness(P.Fingerprint.parse(of(a).text()), of(b)) == P.likeness(of(a), of(b))
    for x in (0, 1, -1, 127, -128, 1 << 40, -(1 << 40), (1 << 63) - 1, -(1 << 63)):
        some = P.Fingerprint(sketch=np.array([x] * P.SKETCH, np.int64))
        assert np.array_equal(P.Fingerprint.parse(some.text()).sketch, some.sketch)
    big = P.Fingerprint(sketch=P.Fingerprint.of(b"a b c d").sketch << 40)
    assert P.likeness(big, P.Fingerprint(wide=big.wide + 1, sketch=big.sketch)) == 1.0


def test_texts_without_white_space():
    r = random.Random(5)
    of = lambda t: P.Fingerprint.of(t.encode())
    han = lambda n: "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n))
    for n in (500, 4000, 40_000):
        a, b = han(n), han(n)
        half = a[: n // 2] + b[: n // 2]
        assert abs(P.likeness(of(a), of(half)) - shared(a, half)) < 0.2 and 0.4 < shared(a, half) < 0.6
        assert P.likeness(of(a), of(b)) < 0.2
    mixed = "short words and " + "x" * 60 + "é" * 30 + " end\n" + han(100) + "\nlast"
    assert P.likeness(of(mixed), of(mixed + " y")) > 0.8
    starts, ends = P._by_characters(np.frombuffer("ab 漢é".encode() + b"z" * 50 + b" c", np.uint8), np.array([0, 3, 59]), np.array([2, 58, 60]))
    assert list(zip(starts, ends))[:4] == [(0, 2), (3, 6), (6, 8), (8, 9)] and (starts[-1], ends[-1]) == (59, 60) and len(starts) == 54


def test_repeated_shingles_do_not_outweigh_the_rest():
    r = random.Random(6)
    of = lambda t: P.Fingerprint.of(t.encode())
    a, b = ("x " * 5000 + data.words(r, 5000, 10**9) for _ in range(2))
    assert P.likeness(of(a), of(b)) < 0.25 and shared(a, b) < 0.01


def test_error_over_many_pairs():
    """Against true shingle overlap: 0.06 on average at most, 0.2 at most."""
    r, errors = random.Random(7), []
    for k in range(120):
        n = r.choice([50, 200, 1000, 5000])
        a = [f"w{r.randrange(10**6)}" for _ in range(n)]
        b = [w if r.random() < k / 120 else f"v{r.randrange(10**6)}" for w in a]
        cut = r.randrange(1, n)
        x, y = (" ".join(t[:cut]) + "\n" + " ".join(t[cut:]) for t in (a, b))
        errors.append(abs(P.likeness(P.Fingerprint.of(x.encode()), P.Fingerprint.of(y.encode())) - shared(x, y)))
    assert sum(errors) / len(errors) < 0.06 and max(errors) < 0.2
