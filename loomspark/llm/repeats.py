"""Suffix-array dedup by prefix-free parsing: bytes covered by a ``length``-byte string that starts anywhere else go.

The corpus is parsed with a rolling hash over ``length`` / 2 bytes.  A trigger is a position whose hash is the least of
all in some string of ``length`` bytes, so that every such string holds a trigger which depends on its bytes alone.  A
phrase is the stretch of text that the strings of one trigger cover.  The dictionary is the table of distinct
phrases; the parse is the table of where each of them occurs.

Positions in corpus order, as far as ``length`` bytes tell them apart, are the suffixes of the dictionary's phrases in
order, each standing for as many positions as its phrase has in the parse:

* a trigger that occurs once: none of its strings starts anywhere else;
* a phrase that occurs again in the parse: all its strings do;
* a phrase that occurs once and whose trigger has other phrases too: its suffixes are sorted together with theirs.

The suffix array of the dictionary is built in blocks: strings that are equal down to ``length`` bytes share a trigger, so
the phrases of one trigger meet in one task and are sorted by prefix doubling on their bytes (8, 16, ... ``length``); equal
ranks at the end are equal strings, byte by byte.  Suffixes that are still equal there are what is sought, so the suffix
array of the parse, which would put them in order, is not built.  Where a trigger has more than ``together`` phrases,
its strings are counted by 128 bits of hash in a distributed aggregation instead.

Hashes: 64 bits for the trigger and 64 independent bits for the phrase, compared together.

Defined cases: null and empty texts, and those shorter than ``length``, lose nothing; rows that repeat wholly repeat
each other's strings; ids play no part but to name rows (null ids too); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import Rolling

TOGETHER = 500
#: Bytes of a block of suffixes that are sorted together; a larger group is a block of its own.
BLOCK = 1 << 15


@lru_cache(maxsize=2)
def _rolling(seed: int) -> Rolling:
    return Rolling(seed)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, in linear time: prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    pad = -len(x) % width
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Phrases:
    """Phrases of one text: starts and ends of their runs of strings, trigger and phrase hashes, self-repeats."""

    def __init__(self, buf: np.ndarray, length: int):
        width = length // 2
        span = length - width + 1
        one, two = _rolling(1), _rolling(2)
        grams = one.windows(one.prefix(buf), width)
        low = sliding_min(grams, span)
        first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        last = np.concatenate([first[1:], [len(low)]])
        size = last - first
        if size.max() > span:  # a trigger that occurs again within reach: no run is longer than the strings of one place
            parts = -(-size // span)
            at = np.repeat(first, parts) + span * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
            last = np.minimum(at + span, np.repeat(last, parts))
            first = at
        self.first, self.last, self.trigger = first, last, low[first]
        self.prefix = two.prefix(buf)
        self.phrase = two.spans(self.prefix, first, last + (length - 1))
        self.again = self._again(grams, span)

    def _again(self, grams: np.ndarray, span: int) -> np.ndarray:
        """Whether the trigger occurs twice within reach of one string: its strings may repeat within the run."""
        few = np.flatnonzero(grams <= self.trigger.max())
        values = grams[few]
        order = np.argsort(values, kind="stable")
        close = (values[order][1:] == values[order][:-1]) & (np.diff(few[order]) < 2 * span)
        twice = np.unique(values[order][1:][close])
        return np.isin(self.trigger, twice)


def parse(docs: DataFrame, length: int, text: str, id_col: str) -> DataFrame:
    """key, a, b (strings a..b-1), trigger, phrase, again: the phrases of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                cols, sizes = [], []
                with np.errstate(over="ignore"):
                    for i, buf in enumerate(common.binary_views(batch.column(1))):
                        if len(buf) >= length:
                            p = Phrases(buf, length)
                            sizes.append((i, len(p.first)))
                            cols.append((p.first, p.last, p.trigger, p.phrase, p.again))
                if cols:
                    a, b, trigger, phrase, again = (np.concatenate(c) for c in zip(*cols, strict=True))
                    key = batch.column(0).take(pa.array(np.repeat([i for i, _ in sizes], [n for _, n in sizes])))
                    yield pa.RecordBatch.from_arrays([key, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(common.signed(trigger)), pa.array(common.signed(phrase)), pa.array(again)], names=["key", "a", "b", "trigger", "phrase", "again"])

    return docs.select(common.row_key(text, id_col).alias("key"), common.utf8(text).alias("t")).mapInArrow(common.released(run), "key binary, a int, b int, trigger long, phrase long, again boolean")


def _strings(buf: np.ndarray, length: int) -> np.ndarray:
    r = _rolling(3)
    return r.windows(r.prefix(buf), length)


def _ranked(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Place of each value among the distinct ones, in order, and how many there are."""
    order = np.argsort(values)
    found = values[order]
    place = np.zeros(len(values), np.int64)
    np.cumsum(found[1:] != found[:-1], out=place[1:])
    out = np.empty(len(values), np.int64)
    out[order] = place
    return out, int(place[-1]) + 1


def suffix_ranks(buf: np.ndarray, length: int) -> np.ndarray:
    """Rank of the suffix at each position by its first ``length`` bytes, as the suffix array has it; equal ones are equal in
    these bytes.  Prefix doubling; the last step overlaps.  Positions with fewer bytes behind them are left out."""
    width = min(8, length)
    first = np.zeros(len(buf) - width + 1, np.uint64)
    for k in range(width):
        first = first << np.uint64(8) | buf[k : k + len(first)]
    rank, kinds = _ranked(first)
    while 2 * width <= length:
        rank, kinds = _ranked(rank[:-width] * kinds + rank[width:])
        width *= 2
    if width < length:
        rank, kinds = _ranked(rank[: width - length] * kinds + rank[length - width :])
    return rank


def _compare(length: int):
    """Rows (trigger, key, a, alone, body), sorted by trigger: strings of an ``alone`` phrase that occur again."""

    def decide(rows: list[tuple]) -> tuple[list, list, list]:
        sizes = np.array([len(r[4]) for r in rows])
        rank = suffix_ranks(np.frombuffer(b"".join(r[4] for r in rows), np.uint8), length)
        number = np.repeat(np.arange(len(rows)), sizes - length + 1)  # the strings of each body
        offset = np.arange(len(number)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1)
        place = rank[(np.cumsum(sizes) - sizes)[number] + offset]
        alone = np.array([r[3] for r in rows])
        again = np.bincount(place, weights=np.where(alone, 1, 2)[number]) >= 2
        hit = again[place] & alone[number]
        n, at = number[hit], np.array([r[2] for r in rows])[number[hit]] + offset[hit]
        if not len(n):
            return [], [], []
        # runs of neighbouring strings of one phrase
        new = np.concatenate([[True], (n[1:] != n[:-1]) | (at[1:] != at[:-1] + 1)])
        begin = np.flatnonzero(new)
        stop = np.concatenate([begin[1:], [len(at)]])
        return [rows[i][1] for i in n[begin]], at[begin].tolist(), (at[stop - 1] + 1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        group: list[tuple] = []  # of one trigger, which may go on
        size = 0
        for whole in batches:
            keys, starts, ends = [], [], []

            def decided(rows: list[tuple]) -> None:
                if rows:
                    for out, found in zip((keys, starts, ends), decide(rows), strict=True):
                        out += found

            for row in zip(*(whole.column(i).to_pylist() for i in range(5)), strict=True):
                if group and group[-1][0] != row[0]:
                    block += group
                    group = []
                    if size > BLOCK:
                        decided(block)
                        block, size = [], 0
                group.append(row)
                size += len(row[4])
            if keys:
                yield _spans(keys, starts, ends)
        if block or group:
            yield _spans(*decide(block + group))

    def _spans(keys: list, starts: list, ends: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["key", "a", "b"])

    return run


def repeated_strings(docs: DataFrame, length: int = 200, text: str = "text", id_col: str = "doc_id", together: int = TOGETHER) -> DataFrame:
    """key and spans (array of a, b): the strings starting at a..b-1 start anywhere else, too."""
    parsed = common.written(parse(docs, length, text, id_col), "phrases")
    # triggers that occur once drop out before anything else is counted
    # what a join by trigger meets is written first, so that the join of a trigger with very many rows can be split
    often = common.written(parsed.groupBy("trigger").agg(F.count("*").alias("total"), F.max("again").alias("again")).where("total > 1 or again").select("trigger"), "triggers")
    phrases = common.written(parsed.join(often, "trigger", "left_semi"), "shared-phrases")
    dictionary = common.written(phrases.groupBy("trigger", "phrase").agg(F.count("*").alias("times"), F.min(F.struct("key", "a")).alias("one"), F.max("again").alias("again")), "dictionary")
    by_trigger = common.written(dictionary.groupBy("trigger").agg(F.count("*").alias("kinds"), F.max("again").alias("selfish")), "kinds")
    verdict = dictionary.join(by_trigger, "trigger").select("trigger", "phrase", "times", "one", "kinds", "selfish").where("times > 1 or kinds > 1 or selfish")
    located = phrases.join(verdict, ["trigger", "phrase"])
    shared = (F.col("kinds") > 1) | F.col("selfish")
    role = F.when(F.col("times") == 1, F.lit("asks")).when(shared & (F.col("one.key") == F.col("key")) & (F.col("one.a") == F.col("a")), F.lit("gives")).otherwise(F.lit("all"))
    marks = located.select("key", F.struct("a", "b", role.alias("role"), F.when(role != "all", F.col("trigger")).alias("trigger"), F.when(role != "all", F.col("kinds")).alias("kinds")).alias("m"))
    marks = common.written(marks.groupBy("key").agg(F.collect_set("m").alias("m")), "marks")
    # the bodies of phrases that must be compared
    open_ = marks.select("key", F.filter("m", lambda x: x["role"] != "all").alias("m")).where(F.size("m") > 0)
    # a row that repeats wholly gives its bodies twice, with the weight of a repeat anyway
    texts = docs.select(common.row_key(text, id_col).alias("key"), common.utf8(text).alias("t")).join(open_, "key")
    bodies = texts.select("key", "t", F.explode("m").alias("m")).select("key", F.col("m.trigger").alias("trigger"), F.col("m.kinds").alias("kinds"), F.col("m.a").alias("a"), (F.col("m.role") == "asks").alias("alone"), F.expr(f"substring(t, m.a + 1, m.b - m.a + {length - 1})").alias("body"))
    bodies = common.written(bodies, "bodies")
    n = int(common.session_of(docs).conf.get("spark.sql.shuffle.partitions"))
    few = bodies.where(F.col("kinds") <= together).select("trigger", "key", "a", "alone", "body").repartition(n, "trigger").sortWithinPartitions("trigger").mapInArrow(common.released(_compare(length)), "key binary, a int, b int")
    many = _many(bodies.where(F.col("kinds") > together), length)
    found = few.unionByName(many).groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("more"))
    whole = F.transform(F.filter("m", lambda x: x["role"] != "asks"), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    none = F.array().cast("array<struct<a:int,b:int>>")
    return marks.join(found, "key", "left").select("key", F.concat(whole, F.coalesce("more", none)).alias("spans")).where(F.size("spans") > 0)


def _many(bodies: DataFrame, length: int) -> DataFrame:
    """The same for triggers of very many phrases: every string is a row, counted with partial aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                with np.errstate(over="ignore"):
                    found = [_strings(b, length) for b in common.binary_views(batch.column(4))]
                sizes = [len(x) for x in found]
                if not sum(sizes):
                    continue
                take = lambda c, kind: np.repeat(batch.column(c).to_numpy(zero_copy_only=False).astype(kind), sizes)
                key = batch.column(1).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                offset = np.concatenate([np.arange(x) for x in sizes])
                yield pa.RecordBatch.from_arrays([pa.array(take(0, np.int64)), pa.array(common.signed(np.concatenate(found))), key, pa.array((take(2, np.int64) + offset).astype(np.int32)), pa.array(take(3, bool))], names=["trigger", "h", "key", "a", "alone"])

    rows = bodies.select("trigger", "key", "a", "alone", "body").mapInArrow(common.released(run), "trigger long, h long, key binary, a int, alone boolean")
    again = rows.groupBy("trigger", "h").agg(F.sum(F.when(F.col("alone"), 1).otherwise(2)).alias("n")).where("n > 1").select("trigger", "h")
    return rows.where("alone").join(again, ["trigger", "h"]).select("key", "a", (F.col("a") + 1).alias("b"))


def covered(spans: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of n bytes lie in a string that starts within the spans."""
    edge = np.zeros(n + 1, np.int64)
    if len(spans):
        np.add.at(edge, spans[:, 0], 1)
        np.add.at(edge, np.minimum(spans[:, 1] + length - 1, n), -1)
    return np.cumsum(edge[:-1]) > 0


def remove(docs: DataFrame, length: int = 200, text: str = "text", id_col: str = "doc_id", with_kept: bool = True, together: int = TOGETHER) -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept_sha256 of each row and, if asked for, ``kept`` (the remaining bytes)."""
    common.tidy(common.session_of(docs))
    spans = repeated_strings(docs, length, text, id_col, together)
    rows = docs.select(common.row_key(text, id_col).alias("key"), F.col(id_col), common.utf8(text).alias("t"))
    joined = rows.join(spans, "key", "left").select(id_col, "t", F.transform("spans", lambda s: s["a"]).alias("a"), F.transform("spans", lambda s: s["b"]).alias("b"))
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept", T.BinaryType())] if with_kept else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                size, removed, runs, digest, kept = [], [], [], [], []
                for buf, a, b in zip(common.binary_views(batch.column(1)), batch.column(2), batch.column(3), strict=True):
                    n, rest, cut = len(buf), buf, np.zeros(0, bool)
                    if a.is_valid:
                        cut = covered(np.column_stack([a.values.to_numpy(), b.values.to_numpy()]).astype(np.int64), n, length)
                        rest = buf[~cut]
                    size.append(n)
                    removed.append(int(cut.sum()))
                    runs.append(int((np.diff(np.concatenate([[0], cut.astype(np.int8)])) == 1).sum()))
                    raw = rest.tobytes()
                    digest.append(hashlib.sha256(raw).hexdigest())
                    if with_kept:
                        kept.append(raw)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), *([pa.array(kept, pa.binary())] if with_kept else [])], names=schema.names)

    return joined.mapInArrow(common.released(run), schema)
