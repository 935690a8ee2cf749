"""MinHash near-dedup with compressed registers (HyperMinHash) and exact confirmation.

1. Each text becomes its set of word shingles; texts with one set form a class, and one row of each class goes on.
2. For each of ``bands * rows`` hash functions the smallest hash of the set is kept as a register of 16 bits: the
   number of its leading zeros and 10 bits behind them.  ``rows`` registers make a band; classes with an equal
   band are in one bucket.
3. No bucket is expanded into pairs.  Every bucket has a centre: the class whose buckets hold the most.  The cell
   of a centre is all classes in its buckets.  Cells are dealt out in blocks, and every member is compared
   with its centre on full sets.
4. Only the members which are not linked with their centre may link others in ways that the centre does not show.
   They are compared with the whole cell, block against block: first by the estimate from the registers,
   corrected for equal registers by chance, with a margin of over four standard deviations, then on full sets.
   A block returns no more links than it takes to connect what it connects.
5. Connected components by repeated hooking to the smallest neighbour and pointer jumping, on written tables.

Two sets of similarity 0.8 share no band with a probability of about 1 in 80,000 (rows 7, bands 48), and then are
still found if anything else links them.

Defined cases: null and empty texts, and texts without words, have an empty set and link with nothing; texts of
fewer words than a shingle have the whole sequence as their one shingle; rows whose set repeats (128 bits of the whole
set) are one class; null ids are passed over when the smallest id is taken, and a group of null ids alone gets null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Rolling

BLOCK, ESTIMATE = 128, 128
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _rolling() -> Rolling:
    return Rolling(77_003)


@lru_cache(maxsize=2)
def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(40_961)
    draw = lambda: r.randint(0, 1 << 32, n, dtype=np.uint64) << np.uint64(32) | r.randint(0, 1 << 32, n, dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def shingles(text: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the shingles of ``size`` words, sorted."""
    buf = _LOWER[text]
    edge = np.diff(np.concatenate([[True], _SPACE[buf], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    r = _rolling()
    words = r.spans(r.prefix(buf), start, end)
    k = min(size, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = common.mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i])
    return np.unique(h)


def registers(h: np.ndarray, n: int) -> np.ndarray:
    """n registers of leading zeros (6 bits) and mantissa (10 bits)."""
    a, b = _factors(n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):
        np.minimum(low, (h[i : i + 1024, None] * a + b).min(0), out=low)
    fraction, exponent = np.frexp(np.maximum(low, 1).astype(np.float64))
    return ((64 - exponent).astype(np.uint16) << np.uint16(10)) | np.minimum((fraction - 0.5) * 2048, 1023).astype(np.uint16)


def estimate(equal: np.ndarray | float, n: int) -> np.ndarray | float:
    """Similarity from the share of equal registers: two unequal minima share a register once in about 1,500 times."""
    chance = 1 / 1536
    return (equal / n - chance) / (1 - chance)


def sketch(docs: DataFrame, size: int, bands: int, rows: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """key, id, n (set size), cls (of the set; null where empty), bands (array of bucket keys)."""
    schema = f"key binary, id {docs.schema[id_col].dataType.simpleString()}, n long, cls binary, bands array<long>"
    n = bands * rows
    number = common.mix(np.arange(bands, dtype=np.uint64) + np.uint64(17))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = _factors(rows)[0]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                size_of, cls, keys = [], [], []
                with np.errstate(over="ignore"):
                    for buf in common.binary_views(batch.column(2)):
                        h = shingles(buf, size)
                        size_of.append(len(h))
                        if not len(h):
                            cls.append(None)
                            keys.append([])
                            continue
                        cls.append(hashlib.blake2b(h, digest_size=16).digest())
                        r = registers(h, n).reshape(bands, rows).astype(np.uint64)
                        keys.append(common.signed(common.mix((common.mix(r + np.uint64(1)) * mult).sum(1, dtype=np.uint64) + number)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size_of, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["key", "id", "n", "cls", "bands"])

    return docs.select(common.row_key(text, id_col).alias("key"), F.col(id_col).alias("id"), common.utf8(text).alias("t")).mapInArrow(common.released(run), schema)


class Links:
    """Union-find over what a block has seen."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: bytes, b: bytes) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b|, on sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compare(percent: int, centre: bool):
    """Rows (cell, block, chunk, role, cls, near, regs, members), sorted by the first four: those of role 0 are compared
    with those of role 1 of the same block.  With ``centre``, role 0 is the centre, and each member comes out
    with whether it is linked; else links come out, as few as connect the same."""
    margin = max(0.0, percent / 100 - 4.5 * (percent / 100 * (1 - percent / 100) / ESTIMATE) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, regs, links = None, [], None, Links()
        for batch in batches:
            cells, blocks, chunks, roles, classes, nears = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            marks, sets = list(common.binary_views(batch.column(6))), list(common.binary_views(batch.column(7)))
            out = []
            for i in range(batch.num_rows):
                at = (cells[i], blocks[i], chunks[i])
                if at != now:
                    now, left, regs, links = at, [], None, Links()
                cls, values = classes[i], np.frombuffer(sets[i].tobytes(), np.uint64)
                mark = np.frombuffer(marks[i].tobytes(), np.uint16)
                if roles[i] == 0:
                    left.append((cls, values, mark))
                    continue
                if centre:
                    out.append((cells[i], cls, any(similar(v, values, percent) for c, v, _ in left if c != cls)))
                    continue
                if not left:
                    continue
                if nears[i]:
                    links.join(cls, cells[i])  # it is linked with the centre already
                if regs is None or len(regs) != len(left):
                    regs = np.array([m for _, _, m in left])
                for j in np.flatnonzero(estimate((regs == mark).sum(1), ESTIMATE) >= margin):
                    c, v, _ = left[j]
                    if c != cls and links.root(c) != links.root(cls) and similar(v, values, percent):
                        links.join(c, cls)
                        out.append((c, cls, True))
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.bool_())], names=["a", "b", "near"])

    return run


def full_sets(docs: DataFrame, wanted: DataFrame, size: int, text: str, id_col: str) -> DataFrame:
    """cls, regs and members (sorted 64-bit hashes) of the wanted (key, cls) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                marks, sets = [], []
                with np.errstate(over="ignore"):
                    for buf in common.binary_views(batch.column(1)):
                        h = shingles(buf, size)
                        marks.append(registers(h, ESTIMATE).tobytes())
                        sets.append(h.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary()), pa.array(sets, pa.binary())], names=["cls", "regs", "members"])

    texts = docs.select(common.row_key(text, id_col).alias("key"), common.utf8(text).alias("t"))
    # a row that repeats wholly gives its set twice, which compares the same twice
    return texts.join(wanted.select("key", "cls"), "key").select("cls", "t").mapInArrow(common.released(run), "cls binary, regs binary, members binary")


def links(docs: DataFrame, classes: DataFrame, size: int, percent: int, text: str, id_col: str) -> DataFrame:
    """Links (a, b) between classes of different sets that connect all that is similar; ``classes`` has one row a class."""
    spark = common.session_of(docs)
    bands = classes.select("cls", F.explode("bands").alias("bucket"))
    full = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = common.written(bands.join(full, "bucket"), "buckets")
    rank = shared.groupBy("cls").agg(F.sum("size").alias("rank"))
    ranked = shared.join(rank, "cls")
    centres = ranked.groupBy("bucket").agg(F.max(F.struct("rank", "cls"))["cls"].alias("cell"))
    cells = common.written(shared.join(centres, "bucket").select("cell", "cls").distinct(), "cells")
    sizes = common.written(cells.groupBy("cell").agg(F.count("*").alias("size")), "sizes")
    wanted = classes.select("key", "cls").join(rank.select("cls"), "cls", "left_semi")
    sets = common.written(full_sets(docs, wanted, size, text, id_col), "sets")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    order = ["cell", "block", "chunk", "role"]
    columns = [*order, "cls", "near", "regs", "members"]

    def dealt(rows: DataFrame) -> DataFrame:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.select(*columns).repartition(n, "cell", "block", "chunk").sortWithinPartitions(*order)

    no = F.lit(False).alias("near")
    members = cells.where("cell <> cls").join(sizes, "cell").select("cell", "cls", F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"), F.lit(0).alias("chunk"), F.lit(1).alias("role"), no)
    heads = sizes.select("cell", F.col("cell").alias("cls"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(0).alias("chunk"), F.lit(0).alias("role"), no)
    seen = common.written(dealt(members.unionByName(heads).join(sets, "cls")).mapInArrow(common.released(_compare(percent, True)), "a binary, b binary, near boolean"), "seen")
    apart = seen.where("not near").select(F.col("a").alias("cell"), F.col("b").alias("cls")).join(sizes.where("size > 2"), "cell")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("left") / BLOCK)).cast("int")
    # what joins by cell meet is written, so that the join of a large cell can be split
    cell_of = common.written(apart.groupBy("cell").agg(F.count("*").alias("left"), F.first("size").alias("size")), "apart")
    asking = apart.select("cell", "cls", "size").join(cell_of.select("cell", "left"), "cell").select("cell", "cls", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.pmod(F.xxhash64("cls"), chunks).cast("int").alias("chunk"), F.lit(0).alias("role"), no)
    asked = seen.withColumnRenamed("a", "cell").withColumnRenamed("b", "cls").join(cell_of, "cell").select("cell", "cls", F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(1).alias("role"), "near")
    more = dealt(asking.unionByName(asked).join(sets, "cls")).mapInArrow(common.released(_compare(percent, False)), "a binary, b binary, near boolean")
    return common.written(seen.where("near").unionByName(more).select("a", "b"), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that each can reach.  Labels double their reach in each round."""
    both = common.written(edges.union(edges.select("b", "a")).toDF("node", "to").where("node <> to").distinct(), "edges")
    label = common.written(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("to"), "label"), "to").groupBy("node").agg(F.min("label").alias("near"))
        hooked = label.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jumped = hooked.alias("x").join(label.select(F.col("node").alias("at"), F.col("label").alias("further")), F.col("label") == F.col("at"), "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "was")
        done = common.written(jumped, "labels")
        label = done.select("node", "label")
        if done.where("label <> was").isEmpty():
            return label


def grouped(docs: DataFrame, size: int, percent: int, bands: int, rows: int, text: str, id_col: str) -> DataFrame:
    """key, id, n and label (the group of the row; null where its set is empty) of each row."""
    common.tidy(common.session_of(docs))
    made = common.written(sketch(docs, size, bands, rows, text, id_col), "sketch")
    one = made.where("cls is not null").groupBy("cls").agg(F.min("key").alias("key"))
    classes = made.select("key", "cls", "bands").join(one, ["key", "cls"]).dropDuplicates(["cls"])
    label = components(links(docs, classes, size, percent, text, id_col))
    return made.select("key", "id", "n", "cls").join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 48, rows: int = 7, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """key, id, n_shingles, component_id (smallest id of the group) and kept (the row has that id) for each row."""
    rows_ = grouped(docs, size, percent, bands, rows, text, id_col)
    # written, so that the join of a large group can be split
    smallest = common.written(rows_.where("label is not null").groupBy("label").agg(F.min("id").alias("component_id")), "smallest")
    out = rows_.join(smallest, "label", "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select("key", "id", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 48, rows: int = 7, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each group: the one of the smallest id (a null id comes last), then of the smallest key; of rows that
    repeat wholly one stays, whatever their other columns.  Documents without a set are no group: all of them stay, but for
    whole repeats."""
    rows_ = common.written(grouped(docs, size, percent, bands, rows, text, id_col), "groups")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    first = rows_.where("label is not null").groupBy("label").agg(F.min(order).alias("f")).select(F.col("f.key").alias("__key"))
    kept = first.unionByName(rows_.where("label is null").select(F.col("key").alias("__key")).distinct())
    stay = docs.withColumn("__key", common.row_key(text, id_col)).join(kept, "__key", "left_semi")
    twice = common.written(rows_.groupBy(F.col("key").alias("__key")).agg(F.count("*").alias("n")).where("n > 1").select("__key"), "twice")
    if twice.isEmpty():
        return stay.select(*docs.columns)
    again = stay.join(twice, "__key", "left_semi").groupBy("__key").agg(F.first(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return stay.join(twice, "__key", "left_anti").select(*docs.columns).unionByName(again)
