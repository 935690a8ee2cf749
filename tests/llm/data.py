"""Small tables with the awkward cases: nulls, empty and long texts, ties, whole repeats, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("key", "id", "score", "lang_pred", "n_lines", "n_removed", "h", "t", "w", "held_out", "kept", "label", "__text_")


def words(r: random.Random, n: int, size: int = 300) -> str:
    return " ".join(f"w{r.randrange(size)}x" for _ in range(n))


def texts(seed: int = 1) -> list[str | None]:
    r = random.Random(seed)
    shared = [words(r, 60), words(r, 90), "é ü " + words(r, 50) + " 漢字 ok"]
    out: list[str | None] = [None, "", " ", "\n\n", "one", "one two", "!!! ...", "a" * 700, "ab" * 400, "x " * 5000]
    for i in range(25):
        parts = [words(r, r.randrange(1, 120)) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, r.choice(shared))
        out.append(r.choice(["\n", " "]).join(parts))
    base = words(r, 200).split()
    for _ in range(6):
        other = list(base)
        for _ in range(r.randrange(0, 12)):
            other[r.randrange(len(other))] = "changed"
        out.append(" ".join(other))
    lines = [words(r, 5) for _ in range(30)]
    out += ["\n".join(lines), "\n".join(lines[5:]), "new line\n" + "\n".join(lines), "\n".join(lines) + "\n" + "\n".join(lines)]
    out += [base and " ".join(base), " ".join(base)]
    return out


def rows(seed: int = 1) -> list[tuple]:
    found = [(i, t, "en" if i % 2 else "de", "s", None if t is None else len(t)) for i, t in enumerate(texts(seed))]
    return found + [found[12], found[12], (None, "null id text " + "z " * 150, None, None, None)]


def table(spark, seed: int = 1, extra: bool = False):
    df = spark.createDataFrame(rows(seed), SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(7).alias(c) for c in EXTRA))
    return df
