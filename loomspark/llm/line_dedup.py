"""Line dedup by content-defined chunks of lines, with DataFrame functions alone.

Each line is hashed once.  A chunk begins at the first line of a text, and at each line where the rolling hash (a cyclic
polynomial) over the hashes of that line and the one before it is divisible by ``modulus``.  Boundaries depend on two
lines only, so an insertion moves no boundary beyond them.  Chunks of several lines which occur more than once in all texts
are found by their hashes, compared byte by byte (they are grouped by their text), and removed but for the first
occurrence: the one of the smallest id, then of the first line.

Chunks alone lose most repeats: a passage without a whole chunk of its own, and a single long line.  ``windows=True``
(the queries) tests, besides the chunks, every window of two neighbouring lines that has a visible character, which
extends a match line by line to both its ends, and every single line of ``words`` words (separated by white space) or
more.  A line goes if any of those that hold it repeats an earlier one; one which overlaps its own first occurrence does
not count, and of three or more blank lines in a row the inner ones may stay.  Every line has an earlier equal one that
stays.

Hashes are counted without any text; the text of a chunk, window or line only moves if its hash occurs twice.  What the
joins on hashes meet is written first, so that the join of a hash with very many rows can be split.

Defined cases: a null text stays null and has no lines; an empty text is one empty line; blank chunks (no
visible character in any line) stay; rows that repeat wholly are the same document and so keep the chunks that
are theirs (near-dedup removes such rows); null ids come first; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def lines_of(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _turned(h: Column, by: int) -> Column:
    return F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by))


def starts_of(hashes: Column, modulus: int) -> Column:
    """Numbers (from 1) of the lines that begin a chunk."""
    rolling = lambda i: F.get(hashes, i - 1).bitwiseXOR(_turned(F.get(hashes, i - 2), 1))
    return F.filter(F.sequence(F.lit(1), F.size(hashes)), lambda i: (i == 1) | (F.pmod(rolling(i), F.lit(modulus)) == 0))


def _between(lines: Column, a: Column, b: Column) -> Column:
    """Lines a..b-1, read one by one: a slice would copy the whole array each time."""
    return F.when(b > a, F.transform(F.sequence(a, F.greatest(a, b - 1)), lambda i: F.element_at(lines, i))).otherwise(F.array().cast("array<string>"))


def spots(docs: DataFrame, modulus: int, least: int, words: int, text: str, id_col: str, windows: bool) -> DataFrame:
    """h, key, first, n of all that is tested: chunks, and with ``windows`` windows of two lines and long lines."""
    cut = docs.where(F.col(text).isNotNull()).select(common.row_key(text, id_col).alias("key"), lines_of(text).alias("lines"))
    cut = common.held(cut, "hs", F.transform("lines", lambda x: F.xxhash64(x)))
    cut = common.held(cut, "seen", F.transform("lines", lambda x: x.rlike(r"\S")))
    long = F.transform("lines", lambda x: (F.length(x) >= 2 * words - 1) & (F.size(F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0))) >= words))
    cut = common.held(cut, "long", long).drop("lines")
    cut = common.held(cut, "starts", starts_of(F.col("hs"), modulus))
    numbers, spot = F.sequence(F.lit(1), F.size("hs")), lambda h, first, n: F.struct(h.alias("h"), first.alias("first"), n.alias("n"))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size("hs") + 1))
    spans = F.transform(F.arrays_zip(F.col("starts").alias("a"), ends.alias("b")), lambda z: F.struct(z["a"].alias("a"), (z["b"] - z["a"]).alias("n")))
    spans = F.filter(spans, lambda z: (z["n"] >= (max(least, 3) if windows else least)) & F.exists(F.slice("seen", z["a"], z["n"]), lambda v: v))  # shorter ones are windows
    found = F.transform(spans, lambda z: spot(F.xxhash64(z["n"], F.slice("hs", z["a"], z["n"])), z["a"], z["n"]))
    if windows:
        two = F.transform(F.filter(numbers, lambda i: F.coalesce(F.get("seen", i - 1) | F.get("seen", i), F.lit(False)) & (i < F.size("hs"))), lambda i: spot(F.xxhash64(F.lit(2), F.get("hs", i - 1), F.get("hs", i)), i, F.lit(2)))
        one = F.transform(F.filter(numbers, lambda i: F.get("long", i - 1)), lambda i: spot(F.xxhash64(F.lit(1), F.get("hs", i - 1)), i, F.lit(1)))
        found = F.concat(found, two, one)
    return cut.select("key", F.inline(found)).select("h", "key", "first", "n")


def runs(docs: DataFrame, modulus: int = 3, least: int = 2, words: int = 50, text: str = "text", id_col: str = "doc_id", windows: bool = True) -> DataFrame:
    """key, first, n: chunks (and with ``windows`` windows of two lines and lines of at least ``words`` words) that repeat an
    earlier one.  Texts move once, to the spots whose hash occurs twice; each then goes on with its own text alone."""
    tested = common.written(spots(docs, modulus, least, words, text, id_col, windows), "spots")
    twice = common.written(tested.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"), "twice")
    wanted = tested.join(twice, "h", "left_semi").groupBy("key").agg(F.collect_set(F.struct("h", "first", "n")).alias("s"))
    texts = docs.where(F.col(text).isNotNull()).select(common.row_key(text, id_col).alias("key"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    texts = common.held(texts.join(wanted, "key"), "lines", lines_of("text"))
    bodies = F.transform("s", lambda s: F.struct(s["h"].alias("h"), s["first"].alias("first"), s["n"].alias("n"), F.array_join(_between(F.col("lines"), s["first"], s["first"] + s["n"]), "\n").alias("body")))
    same = common.written(texts.select("key", "id", F.inline(bodies)), "runs")
    first = same.groupBy("h", F.col("body").alias("other")).agg(F.min(F.struct("id", "first", "key")).alias("f"), F.count("*").alias("times")).where("times > 1")
    joined = same.join(common.written(first.select("h", "other", "f"), "firsts"), "h").where(F.col("body") == F.col("other"))
    apart = (F.col("f.key") != F.col("key")) | (F.col("first") >= F.col("f.first") + F.col("n"))
    return joined.where(apart).select("key", "first", "n").distinct()


def _stretches(found: DataFrame) -> DataFrame:
    """key and __out: the lines of all spans of a key as (first, n) that neither touch nor overlap, in order."""
    lines = found.select("key", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("i"))
    by = common.held(lines.groupBy("key").agg(F.collect_set("i").alias("i")), "l", F.array_sort("i"))
    edge = lambda step: F.filter("l", lambda x, i: F.coalesce(F.get("l", i + step) != x + step, F.lit(True)))
    return by.select("key", F.transform(F.arrays_zip(edge(-1).alias("a"), edge(1).alias("b")), lambda z: F.struct(z["a"].alias("first"), (z["b"] - z["a"] + 1).alias("n"))).alias("__out"))


def deduplicate(docs: DataFrame, modulus: int = 3, least: int = 2, text: str = "text", id_col: str = "doc_id", counts: tuple[str, str] = ("n_lines", "n_removed"), windows: bool = False, words: int = 50) -> DataFrame:
    """``docs`` with the repeated chunks (``windows``: and windows of two lines, and lines of ``words`` words) taken out
    of ``text``, and the columns ``counts``: lines, and lines removed.  They take the place of columns of those names."""
    common.tidy(common.session_of(docs))
    out = _stretches(runs(docs, modulus, least, words, text, id_col, windows)).withColumnRenamed("key", "__key")
    rows = docs.withColumn("__key", common.row_key(text, id_col)).join(out, "__key", "left")
    rows = common.held(rows, "__all", lines_of(text))
    lines = F.col("__all")
    # what stays: the stretches between the removed chunks, each sliced once
    before = F.concat(F.array(F.lit(1)), F.transform("__out", lambda o: o["first"] + o["n"]))
    until = F.concat(F.transform("__out", lambda o: o["first"]), F.array(F.size(lines) + 1))
    stay = F.flatten(F.transform(F.arrays_zip(before.alias("a"), until.alias("b")), lambda z: _between(lines, z["a"], z["b"])))
    n_removed = F.coalesce(F.aggregate("__out", F.lit(0).cast("long"), lambda s, o: s + o["n"]), F.lit(0).cast("long"))
    rest = [F.col(c) for c in docs.columns if c != text]
    made = rows.select(*rest, F.when(F.col("__out").isNull(), F.col(text)).otherwise(F.array_join(stay, "\n")).alias("__text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("__lines"), n_removed.alias("__removed"))
    names = {text: "__text", counts[0]: "__lines", counts[1]: "__removed"}
    return made.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns), *(F.col(names[c]).alias(c) for c in counts if c not in docs.columns))
