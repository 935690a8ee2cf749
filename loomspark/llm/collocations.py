"""Phrase collocations: all phrases of 1 to ``most_words`` words as rows, counted per language, scored by cohesion.

Texts become pieces (cut at ``.,;:!?`` and line ends) and pieces words (runs of anything but space and tab, A-Z as a-z).
Each length is one pass over the texts: every contiguous occurrence of that many words of a piece is counted where it is
read (blocks of ``FLUSH_BYTES`` of text), becomes a row (lang, phrase, count), and the rows are summed by a grouped aggregate.
One pass a length keeps only one length's rows on disk at a time.  Only phrases of ``least`` occurrences are kept: a part of a
phrase occurs at least as often as the phrase, so no score needs others.  No phrase is left out before it is counted.

Cutting a candidate after its first k words gives the counts l and r of both parts, by two joins; a score is
floor(1,000,000 a a / (l r)) in Decimal, exact for counts below 10**16 (more raise).  The cut of the lowest score counts, ties go
to the smallest k.  A candidate goes that one longer by a word covers: counts fall with length, so if any longer one covers it,
one longer by a word does.

Defined cases: a null text is empty; a null language is ``und`` and one with it; empty texts and pieces have no phrase; rows that
repeat count each; an empty table gives an empty result; ties in rank go to the larger count, then to the phrase that is smaller
by its bytes; texts of any length are counted whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of text that are counted together before rows are made of them; rows of one Arrow batch.
FLUSH_BYTES, BATCH_ROWS = 12 << 20, 1 << 16
#: Parts of a language that are ranked on their own first.
RANK_PARTS = 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of binary texts, dictionary encoded, and for each the number of its piece."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    buf = np.concatenate([*common.binary_views(texts), np.zeros(0, np.uint8)])
    kind = _KIND[buf]
    word, first = kind == 0, np.zeros(len(buf) + 1, bool)
    first[np.cumsum(sizes) - sizes] = True  # of each text
    piece = np.cumsum((kind == 2) | first[:-1], dtype=np.int32)
    before = np.concatenate([np.zeros(1, bool), word[:-1]])
    after = np.concatenate([word[1:], np.zeros(1, bool)])
    starts, ends = np.flatnonzero(word & (~before | first[:-1])), np.flatnonzero(word & (~after | first[1:])) + 1
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[buf[word]])])
    return found.dictionary_encode(), piece[starts]


def count_block(texts: pa.Array, size: int) -> tuple[pa.Array, np.ndarray, int]:
    """Phrases of ``size`` words of these texts, how often each occurs, and the number of words."""
    words, piece = words_of(texts)
    names, at = words.dictionary, words.indices.to_numpy().astype(np.int64)
    if size == 1:
        return names, np.bincount(at, minlength=len(names)), len(at)
    n = len(at) - size + 1
    if n <= 0:
        return names.slice(0, 0), np.zeros(0, np.int64), len(at)
    inside = np.flatnonzero(piece[:n] == piece[size - 1 :])
    code, base, parts = at[inside], len(names), []
    for k in range(1, size):  # one number a phrase; where it would not fit, numbers are first made dense
        if len(parts) == 0 and base ** (k + 1) < 1 << 62:
            code = code * base + at[inside + k]
        else:
            kinds, code = np.unique(code, return_inverse=True)
            parts.append((kinds, k))
            code = code * base + at[inside + k]
    code.sort()
    edge = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]]))
    counts, code = np.diff(np.append(edge, len(code))), code[edge]
    columns = []
    for k in range(size - 1, 0, -1):
        code, w = np.divmod(code, base)
        columns.append(names.take(pa.array(w)))
        if parts and parts[-1][1] == k:
            code = parts.pop()[0][code]
    columns.append(names.take(pa.array(code)))
    return pc.binary_join_element_wise(*columns[::-1], pa.scalar(" ", pa.large_string())), counts, len(at)


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def phrase_counts(docs: DataFrame, size: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase and f of all phrases of ``size`` words; with 1, the row of a null phrase has the number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, FLUSH_BYTES):
            langs = block["lang"].combine_chunks()
            for label in pc.unique(langs).to_pylist():
                texts = block["text"].filter(pc.equal(langs, label)).cast(pa.large_binary()).combine_chunks()
                phrases, counts, n = count_block(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, size)
                if size == 1 and n:
                    yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([None], pa.string()), pa.array([n], pa.int64())], names=["lang", "phrase", "f"])
                for i in range(0, len(counts), BATCH_ROWS):
                    part = phrases.slice(i, BATCH_ROWS).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(part)), part, pa.array(counts[i : i + BATCH_ROWS], pa.int64())], names=["lang", "phrase", "f"])

    common.tidy(common.session_of(docs))
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), common.utf8(text).alias("text"))
    return rows.mapInArrow(common.released(count), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _words(phrase: Column, at: int, size: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), at, size), " ")


def _parts(words: Column, size: int) -> Column:
    """Each way to cut a phrase of ``size`` words in two."""
    return F.array(*(F.struct(F.lit(k).alias("k"), _words(words, 1, k).alias("head"), _words(words, k + 1, size - k).alias("tail")) for k in range(1, size)))


def _whole(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, cover: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``top`` phrases of 2 to ``most_words`` words of each language.

    ``least``: occurrences of a candidate; ``cover``: in percent of a phrase's occurrences, those of a longer candidate
    around it that make it go."""
    counted = {}
    for size in range(1, most_words + 1):
        counted[size] = common.written(phrase_counts(docs, size, text, lang).where((F.col("f") >= least) | F.col("phrase").isNull()), f"phrases-{size}")
    words = counted[1].where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    shorter = counted[1].where(F.col("phrase").isNotNull())
    for size in range(2, most_words):
        shorter = shorter.unionByName(counted[size])

    cuts = [counted[size].select("lang", "phrase", F.col("f").alias("a"), F.inline(_parts(F.col("phrase"), size))) for size in range(2, most_words + 1)]
    every = cuts[0]
    for more in cuts[1:]:
        every = every.unionByName(more)
    cut = every.join(shorter.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(shorter.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    # Decimal products of 38 digits; ``div`` is floor, as all numbers are positive
    scored = cut.withColumn("over", F.lit(10**6).cast("decimal(7,0)") * (_whole("a") * _whole("a"))).withColumn("under", _whole("l") * _whole("r"))
    exact = F.when(F.col("over").isNull() | (F.col("a") >= 10**16), F.raise_error(F.lit("counts of 10**16 and more don't fit exact scores")).cast("long")).otherwise(F.expr("over div under"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("at"))

    longer = None
    for size in range(3, most_words + 1):
        ends = counted[size].select("lang", F.explode(F.array(_words(F.col("phrase"), 1, size - 1), _words(F.col("phrase"), 2, size - 1))).alias("phrase"), F.col("f").alias("around"))
        longer = ends if longer is None else longer.unionByName(ends)
    kept = best.select("lang", "phrase", "a", "at.l", "at.r", "at.score")
    if longer is not None:
        largest = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
        same = (kept["lang"] == largest["lang"]) & (kept["phrase"] == largest["phrase"]) & (100 * largest["around"] >= cover * kept["a"])
        kept = kept.join(largest, same, "left_anti")

    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
