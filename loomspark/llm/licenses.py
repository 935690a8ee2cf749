"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Candidate notices of a text are its lines, windows of two and three neighbouring lines, its sentences (across lines),
and the windows of as many terms as a template has that hold one of its rare terms, so that a notice is found where it
is wrapped, or stands within a line that says more.  The whole text and its first terms, as many as the template has,
are held against full licence texts (``licence_texts``).  A licence file (by its name) is held against the short notices
as a whole, too.

Terms are runs of ASCII letters and digits, lower-cased; the weight of a term in a notice is its count times
ln((N + 1) / (df + 1)) + 1, with N the number of texts and df the number of texts that hold the term, over the whole
table and for all terms.  A text takes the template of the largest cosine if that is ``least`` or more.

Only texts with one of some terms of a template are weighed: as many terms as leave the rest of the template a norm below
``least`` of the whole.  That bound is exact: other terms only lower a cosine.  The weights of the distinct terms of such a
text are joined to it, and all its candidates are spans of its term positions: a dot product is a difference of running sums,
and windows of one length are weighed side by side.  So the work of a text grows with its positions, and no candidate becomes a row
before it is known to reach ``least``.

A file without a notice of its own inherits from the nearest directory above it that has one: the directory's
licence is that of its licence files or else of its licensed files, the smallest path first.  Directories are
aggregated before they are joined, so a directory with a third of all files is one row.

Defined cases: null and empty texts have no notice and may inherit; a null path has no directory and can't
inherit; equal cosines go to the first candidate (lines, then windows of terms, then the whole), then to the template whose
id sorts first; rows that repeat give one result each; texts of any length are weighed whole; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .decontaminate import LOWER, UPPER

# Licence ids and the usual notice of each.
TEMPLATES = {
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution 4.0 International License (CC BY 4.0).",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0 Universal.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Tags that name a licence; a candidate must have the terms of one and no others.
TAGS = {f"tag:{name}": f"SPDX-License-Identifier: {name}" for name in TEMPLATES}
TERM = r"[a-z0-9]+"
_ASCII = str.maketrans(UPPER, LOWER)
#: Ends of sentences: a stop and a capital after it ("v. 2.0" goes on), or a blank line.
SENTENCE = regex.compile(r"(?<=[.!?])\s+(?=\p{Lu})|\n\s*\n")
SALTS = 64
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def _terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def full_texts() -> dict[str, str]:
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def frequencies(files: DataFrame, text: str) -> tuple[DataFrame, int]:
    """term and w, the weight of every term of the table, and the number of texts."""
    n = files.count()
    found = files.select(F.explode(F.array_distinct(terms_of(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return common.written(found.select("term", "df", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("w")), "frequencies"), n


def weights(df: DataFrame, n: int, templates: list[str]) -> tuple[dict[str, float], set[str]]:
    """Weight of each term of the templates, and which of them more than one text in 50 has."""
    vocabulary = sorted({t for x in templates for t in _terms(x)})
    terms = F.broadcast(common.session_of(df).createDataFrame([(t,) for t in vocabulary], "term string"))  # a few thousand by their definition
    found = {r.term: r for r in df.join(terms, "term").collect()}
    return {t: found[t].w if t in found else math.log(n + 1) + 1 for t in vocabulary}, {t for t, r in found.items() if r.df > n / 50}


def template_vectors(templates: dict[str, str], weight: dict[str, float]) -> dict[str, dict[str, float]]:
    out = {}
    for name, text in templates.items():
        v: dict[str, float] = {}
        for t in _terms(text):
            v[t] = v.get(t, 0.0) + weight[t]
        norm = math.sqrt(sum(x * x for x in v.values()))
        out[name] = {t: x / norm for t, x in v.items()}
    return out


def key_terms(vectors: dict[str, dict[str, float]], least: float, common_terms: frozenset[str] | set[str] = frozenset()) -> list[str]:
    """Terms of which a notice must have one to reach ``least``; the common ones only where the others don't do."""
    keys = set()
    for v in vectors.values():
        rest = 1.0
        for t, x in sorted(v.items(), key=lambda i: (i[0] in common_terms, -i[1], i[0])):
            if math.sqrt(max(rest, 0.0)) < least - 1e-9:
                break
            keys.add(t)
            rest -= x * x
    return sorted(keys)


def _pattern(keys: list[str]) -> str:
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(keys) + r")(?![a-z0-9])"


class Weigher:
    """Weighs all candidates of one text against the templates."""

    def __init__(self, short: dict[str, dict[str, float]], full: dict[str, dict[str, float]], lengths: list[int], heads: list[int], short_keys: list[str], full_keys: list[str], least: float):
        self.terms = {t: i for i, t in enumerate(sorted({t for v in (*short.values(), *full.values()) for t in v}))}
        self.names = {"short": sorted(short), "full": sorted(full)}
        self.matrix = {kind: np.array([[vs[n].get(t, 0.0) for t in self.terms] for n in self.names[kind]]).reshape(len(vs), -1) for kind, vs in (("short", short), ("full", full))}
        self.least = {kind: np.array([1 - 1e-6 if n.startswith("tag:") else least for n in self.names[kind]]) for kind in self.names}
        self.lengths, self.heads, self.short, self.full = lengths, heads, frozenset(short_keys), frozenset(full_keys)

    def best(self, text: str, weight: dict[str, float], file: bool) -> tuple[str, float] | None:
        places = [(m.start(), m.group()) for m in re.finditer(TERM, text.translate(_ASCII))]
        starts, terms = np.array([p for p, _ in places], np.int64), [t for _, t in places]
        kinds: dict[str, int] = {}
        code = np.fromiter((kinds.setdefault(t, len(kinds)) for t in terms), np.int64, len(terms))
        w = np.array([weight[t] for t in kinds])
        column = np.array([self.terms.get(t, -1) for t in kinds])
        found: list[tuple] = []
        key = np.fromiter((t in self.short for t in kinds), bool, len(kinds))[code]
        if key.any():
            hits = np.append(0, np.cumsum(key))
            for k, (a, z) in enumerate(self._parts(text, starts, file)):
                if hits[z] > hits[a]:
                    found += self._span("short", (0, k), code[a:z], w, column)
            for m in self.lengths:
                found += self._windows(m, code, w, column, hits)
        if self.full and any(t in self.full for t in kinds):
            for m in sorted({len(code), *(min(h, len(code)) for h in self.heads)}):
                found += self._span("full", (2, m), code[:m], w, column)
        if not found:
            return None
        score, _, name = min(found)
        return name.removeprefix("tag:"), -score

    def _parts(self, text: str, starts: np.ndarray, file: bool) -> Iterator[tuple[int, int]]:
        """Spans of terms: lines, the whole of a licence file, two and three lines, sentences."""
        ends = [i for i, c in enumerate(text) if c == "\n"] + [len(text)]
        lines = np.append(0, np.searchsorted(starts, ends)).tolist()
        yield from zip(lines[:-1], lines[1:], strict=True)
        if file:
            yield 0, len(starts)
        for k in (2, 3):
            yield from zip(lines[:-k], lines[k:], strict=True)
        cuts = [0, *(x for m in SENTENCE.finditer(text) for x in (m.start(), m.end())), len(text)]
        at = np.searchsorted(starts, cuts).tolist()
        yield from zip(at[::2], at[1::2], strict=True)

    def _span(self, kind: str, order: tuple[int, int], code: np.ndarray, w: np.ndarray, column: np.ndarray) -> list[tuple]:
        which, tf = np.unique(code, return_counts=True)
        x = tf * w[which]
        norm = math.sqrt(float((x * x).sum()))
        known = column[which] >= 0
        scores = self.matrix[kind][:, column[which[known]]] @ x[known] / norm if norm else np.zeros(len(self.names[kind]))
        return [(-round(float(scores[i]), 9), order, self.names[kind][i]) for i in np.flatnonzero(np.round(scores, 9) >= self.least[kind])]

    def _windows(self, m: int, code: np.ndarray, w: np.ndarray, column: np.ndarray, hits: np.ndarray, step: int = 1 << 14) -> list[tuple]:
        """All windows of m terms with a key term, ``step`` of them side by side."""
        out: list[tuple] = []
        at = np.flatnonzero(hits[m:] > hits[:-m]) if len(hits) > m else np.zeros(0, np.int64)
        for i in range(0, len(at), step):
            a = at[i : i + step]
            c = code[a[:, None] + np.arange(m)]
            same = np.zeros(c.shape)
            for k in range(m):
                same += c == c[:, k : k + 1]  # how often each term is in its window
            x = w[c]
            norm = np.sqrt((x * x * same).sum(1))
            of = column[c]
            share = np.where(of >= 0, x, 0.0)
            for j, name in enumerate(self.names["short"]):
                scores = np.round((share * self.matrix["short"][j][of]).sum(1) / norm, 9)
                for r in np.flatnonzero(scores >= self.least["short"][j]):
                    out.append((-float(scores[r]), (1, int(a[r] + 1) * 1000 + m), name))
            out = [min(out)] if out else out
        return out


def notices(files: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, text: str = "text", path: str = "path") -> DataFrame:
    """key, license and score: the best notice of each text that has one.  Full licence texts are held beside
    the templates of the module only."""
    full = {} if templates else full_texts()
    templates = templates or TEMPLATES | TAGS
    df, n = frequencies(files, text)
    weight, frequent = weights(df, n, [*templates.values(), *full.values()])
    vectors, wide = template_vectors(templates, weight), template_vectors(full, weight)
    short_keys, full_keys = key_terms(vectors, least), key_terms(wide, least, frequent)
    weigher = Weigher(vectors, wide, sorted({len(_terms(x)) for x in templates.values()}), sorted({len(_terms(x)) for x in full.values()}), short_keys, full_keys, least)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, body, file, terms, ws in zip(*(c.to_pylist() for c in b.columns), strict=True):
                best = weigher.best(body, dict(zip(terms, ws, strict=True)), bool(file))
                if best:
                    out.append((key, *best))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.float64())], names=["key", "license", "score"])

    rows = files.where(F.col(text).rlike(_pattern(sorted({*short_keys, *full_keys})))).select(common.row_key(text, path).alias("key"), F.col(text).alias("text"), F.col(path).rlike(LICENCE_FILE).alias("file"))
    rows = common.written(rows, "candidates")
    # rows that repeat wholly have one key, and become one set of terms before anything is shuffled
    terms = rows.select("key", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).groupBy("key", "term").agg(F.lit(1).alias("one"))
    weighed = common.written(terms.join(df.select("term", "w"), "term").groupBy("key").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("ws")), "weighed")
    found = rows.join(weighed, "key").select("key", "text", "file", "terms", "ws").mapInArrow(common.released(weigh), "key binary, license string, score double")
    return found.groupBy("key").agg(F.first("license").alias("license"), F.first("score").alias("score"))


def parents(path: Column) -> Column:
    """The directories above a path, nearest first; the top directory is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def scan(files: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, text: str = "text", path: str = "path", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, ``path``, license, score, via ('own', 'inherited' or null) and from_path (the file or directory)."""
    common.tidy(common.session_of(files))
    own = notices(files, templates, least, text, path)
    rows = files.select(*keep, F.col(path).alias("path"), common.row_key(text, path).alias("key")).join(own, "key", "left")
    rows = common.written(rows, "notices")
    licensed = rows.where("license is not null and path is not null").select(F.element_at(parents(F.col("path")), 1).alias("dir"), F.struct((~F.col("path").rlike(LICENCE_FILE)).alias("plain"), F.col("path").alias("path"), "license").alias("s"))
    by_dir = licensed.groupBy("dir").agg(F.min("s").alias("s")).select("dir", F.col("s.license").alias("dir_license"))
    bare = rows.where("license is null and path is not null").select("path", F.element_at(parents(F.col("path")), 1).alias("home"))
    homes = bare.select("home").distinct()
    above = homes.select("home", F.posexplode(F.concat(F.array("home"), F.when(F.col("home") == "", F.array().cast("array<string>")).otherwise(parents(F.col("home"))))).alias("up", "dir"))
    nearest = above.join(by_dir, "dir").groupBy("home").agg(F.min(F.struct("up", "dir", "dir_license")).alias("n")).select("home", F.col("n.dir").alias("from_dir"), F.col("n.dir_license").alias("dir_license"))
    # files of one directory are spread over SALTS tasks, as one may hold a third of them
    nearest = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    home = F.when(F.col("license").isNull() & F.col("path").isNotNull(), F.element_at(parents(F.col("path")), 1))
    out = rows.withColumn("home", home).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(nearest, ["home", "salt"], "left")
    via = F.when(F.col("license").isNotNull(), F.lit("own")).when(F.col("dir_license").isNotNull(), F.lit("inherited"))
    return out.select(*keep, "path", F.coalesce("license", "dir_license").alias("license"), "score", via.alias("via"), F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("from_dir")).alias("from_path"))
