"""Benchmark decontamination with DataFrame functions alone.

The distinct windows of ``size`` words of the benchmark make a hash set, which is broadcast if its counted bytes
allow it and joined by a shuffle if not.  The token windows of the texts are hashed and looked up in it; a hit is
then verified word by word on the exact text of the window.  Texts go through the scan once and are not shuffled.
Which items a window belongs to is a table of its own, however many they are, and meets the hits alone.

Words are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z.  An item of fewer
words than ``size`` is one window of its own length.

Defined cases: null and empty texts have no words; an item without words can't occur; items of equal text are all
found; rows that repeat give one result each; a null item id counts as a hit but is not listed; an empty benchmark
or table gives no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The words' characters, on texts before A-Z become a-z: ASCII letters and digits and all beyond ASCII.  Those below
#: U+0100 are listed one by one, which Java looks up in a table.
WORDS = "[" + LOWER + UPPER + "0123456789" + "".join(map(chr, range(0x80, 0x100))) + r"\x{100}-\x{10FFFF}]+"
#: Bytes of windows of a benchmark that may be broadcast (their text, and ROW_BYTES more for each).
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64


def words_of(text: str | Column) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORDS), F.lit(0))


def _window(words: Column, at: Column, size: Column) -> Column:
    """The exact text of a window, A-Z as a-z."""
    return F.translate(F.array_join(F.slice(words, at, size), " "), UPPER, LOWER)


def _hash(hashed: Column, at: Column, size: int) -> Column:
    """Hash of the window at ``at``; single elements are read, as a slice would copy the whole array."""
    return F.xxhash64(*(F.element_at(hashed, at + k) for k in range(size)))


def _hashes(hashed: Column, size: int) -> Column:
    """Hashes of all windows, in order."""
    n = F.size(hashed) - (size - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _hash(hashed, i, size))).otherwise(F.array().cast("array<bigint>"))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def benchmark_windows(benchmark: DataFrame, size: int, text: str = "text", id_col: str = "item_id") -> DataFrame:
    """h, length, window (its exact text), id (128 bits of it) and item of each window of each item, written."""
    base = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(text).alias("w")).where(F.size("w") > 0)
    base = base.withColumn("length", F.least(F.size("w"), F.lit(size)))
    base = common.held(base, "hw", _word_hashes(F.col("w")))
    at = base.select("item", "w", "hw", "length", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("at"))
    h = F.coalesce(*(F.when(F.col("length") == n, _hash(F.col("hw"), F.col("at"), n)) for n in range(1, size + 1)))
    cut = at.select("item", "length", h.alias("h"), F.translate(F.array_join(F.slice("w", F.col("at"), F.col("length")), " "), UPPER, LOWER).alias("window"))
    return common.written(cut.withColumn("id", F.unhex(F.md5("window"))).distinct(), "windows")


def hits(docs: DataFrame, windows: DataFrame, size: int = 10, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """key, pos, length, id: the verified windows (of ``benchmark_windows``) in each text, written."""
    windows = windows.select("h", "length", "window", "id").distinct()
    count = windows.groupBy("length").agg(F.sum(F.octet_length("window") + ROW_BYTES).alias("bytes")).collect()  # one row a window length, ``size`` at most
    small = sum(r.bytes for r in count) <= BROADCAST_BYTES
    lengths = sorted({r.length for r in count}) or [size]
    words = docs.select(common.row_key(text, id_col).alias("key"), words_of(text).alias("w"))
    hashed = common.held(words, "hw", _word_hashes(F.col("w")))
    if len(lengths) == 1:
        length, hs = F.lit(lengths[0]), _hashes(F.col("hw"), lengths[0])
    else:
        hashed = hashed.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("length"))
        length, hs = F.col("length"), F.coalesce(*(F.when(F.col("length") == n, _hashes(F.col("hw"), n)) for n in lengths))
    # the hashes are a column of their own, so that the generator is compiled into one stage with a broadcast join and
    # the words of a text are not copied for each of its windows; rows that are shuffled leave the words behind
    carried = ["key", "w"] if small else ["key"]
    at = hashed.select(*carried, length.alias("length"), hs.alias("hs")).select(*carried, "length", F.posexplode("hs").alias("pos", "h"))
    wanted = windows.withColumnRenamed("length", "__n")
    found = at.join(F.broadcast(wanted) if small else wanted, "h").where(F.col("length") == F.col("__n"))
    if not small:
        found = found.join(words, "key")
    # the text of a window is made for hits of the hash alone: as a condition it would be a key of the join
    hit = common.held(found, "exact", _window(F.col("w"), F.col("pos") + 1, F.col("length")))
    return common.written(hit.where(F.col("exact") == F.col("window")).select("key", "pos", "length", "id"), "hits")


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, n_words, n_hit, n_items, items_sha256 and contaminated of each row, and its ``key``."""
    common.tidy(common.session_of(docs))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.col("spans"), lambda s: F.sequence(s["pos"], s["pos"] + s["length"] - 1)))))
    windows = benchmark_windows(benchmark, size)
    hit = hits(docs, windows, size, text, id_col)
    found = hit.groupBy("key").agg(F.collect_set(F.struct("pos", "length")).alias("spans")).select("key", covered.cast("long").alias("n_hit"))
    items = hit.select("key", "id").distinct().join(windows.select("id", "item").where("item is not null"), "id").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = docs.select(common.row_key(text, id_col).alias("key"), F.col(id_col), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS)).cast("long").alias("n_words"))
    out = rows.join(found.join(items, "key", "left"), "key", "left")
    none = F.array().cast("array<string>")
    items = F.coalesce("items", none)
    return out.select("key", id_col, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    common.tidy(common.session_of(docs))
    bad = hits(docs, benchmark_windows(benchmark, size), size, text, id_col).select(F.col("key").alias("__key")).distinct()
    return docs.withColumn("__key", common.row_key(text, id_col)).join(bad, "__key", "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", id_col: str = "doc_id", mark: str = " ") -> DataFrame:
    """The documents with every hit word, and what is between hit words that follow each other, replaced by ``mark``.

    A text is cut into its words and what lies between them; words that are hit are left out."""
    common.tidy(common.session_of(docs))
    found = hits(docs, benchmark_windows(benchmark, size), size, text, id_col).groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("pos"), F.col("pos") + F.col("length") - 1)))).alias("__hit")).withColumnRenamed("key", "__key")
    rows = docs.withColumn("__key", common.row_key(text, id_col)).join(found, "__key", "left")
    rows = common.held(common.held(rows, "__words", words_of(text)), "__gaps", F.split(F.col(text), WORDS))
    n = F.size("__words")
    rows = common.held(rows, "__lost", F.transform(F.sequence(F.lit(0), n), lambda i: F.array_contains("__hit", i)))
    parts = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when(~F.element_at("__lost", i), F.concat(F.element_at("__words", i), F.element_at("__gaps", i + 1)))
        .when(F.element_at("__lost", i + 1), F.lit(""))
        .otherwise(F.concat(F.lit(mark), F.element_at("__gaps", i + 1))),
    )
    kept = F.concat(F.element_at("__gaps", 1), F.array_join(parts, ""))
    return rows.withColumn(text, F.when(F.col("__hit").isNull(), F.col(text)).otherwise(kept)).select(*docs.columns)
