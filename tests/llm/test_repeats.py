from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from loomspark.llm import repeats

from . import data


def brute(rows, length):
    bufs = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[a : a + length] for _, b in bufs for a in range(len(b) - length + 1))
    for i, b in bufs:
        cut = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if seen[b[a : a + length]] > 1:
                cut[a : a + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        runs = sum(1 for k in range(len(cut)) if cut[k] and (k == 0 or not cut[k - 1]))
        yield i, len(b), sum(cut), runs, hashlib.sha256(kept).hexdigest()


def ordered(x):
    return sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("seed,length,together", [(1, 200, 2000), (2, 200, 0), (3, 40, 2000)])
def test_same_as_comparing_all_strings(spark, seed, length, together):
    got = repeats.remove(data.table(spark, seed, extra=True), length, with_kept=False, together=together).collect()
    assert ordered(map(tuple, got)) == ordered(brute(data.rows(seed), length))


@pytest.mark.parametrize("length", [3, 8, 20, 200])
def test_suffix_ranks(length):
    r = np.random.RandomState(length)
    base = r.randint(97, 100, 300, dtype=np.uint8)
    buf = np.concatenate([base, r.randint(97, 100, 100, dtype=np.uint8), base])
    strings = [bytes(buf[i : i + length]) for i in range(len(buf) - length + 1)]
    place = {x: i for i, x in enumerate(sorted(set(strings)))}
    assert repeats.suffix_ranks(buf, length).tolist() == [place[x] for x in strings]


def test_empty_table(spark):
    assert repeats.remove(data.table(spark).limit(0), 200).count() == 0
