"""Document fingerprints: a homomorphic multiset hash.

Each paragraph (line) of a text hashes to a wide vector; the fingerprint is the sum of the vectors of all its
paragraphs, lane by lane, modulo powers of two.  The order of paragraphs does not matter, and ``insert`` and
``delete`` change a fingerprint without the rest of the text.  A vector has two kinds of lanes:

* 8 lanes modulo 2**64, uniform in the paragraph's digest: these decide equality;
* 256 lanes modulo 2**64, read as signed numbers, to which every kind of two-word shingle of the paragraph adds +1 or -1 in one
  lane (a counting sketch): the inner product of two such parts estimates how many shingles two texts share, so
  that ``likeness`` grades texts which are not equal.  A shingle counts once a paragraph, so that one which is repeated
  thousands of times there doesn't outweigh all others; of words of over ``LONG`` bytes (scripts without white space) each
  character is a word.  Its standard error is about 1 / sqrt(256) = 0.06.

Likeness of a and b: 2<a,b> / (<a,a> + <b,b>) over the sketch lanes, held to 0..1; 1 where both are equal, and
0 where just one is empty.  A fingerprint is written as hex: the 8 wide lanes, a colon, and the sketch lanes as
base64 of its numbers, compressed: signs folded into the lowest bit, then all lowest bytes, all second bytes, and so on, so that
the many high bytes of small counts take next to nothing.

Defined cases: a null text is empty (all lanes 0); rows are taken in the order of doc_id (null ids first), then of the
MD5 of the text (a null text's before all), so that ties and repeated rows have a defined successor and the rows of
one id are spread over many tasks; one row is its own successor; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import Rolling

WIDE, SKETCH = 8, 256
#: Bytes of a word beyond which its characters are taken one by one.
LONG = 48
_M = (1 << 64) - 1


@lru_cache(maxsize=1)
def _rolling() -> Rolling:
    return Rolling(20260801)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def wide_lanes(paragraph: bytes) -> np.ndarray:
    return np.frombuffer(hashlib.shake_128(paragraph).digest(8 * WIDE), "<u8")


def sketch_lanes(buf: np.ndarray) -> np.ndarray:
    """Signed numbers of the kinds of two-word shingles inside each paragraph of ``buf``; a paragraph of one word counts that word."""
    if not len(buf):
        return np.zeros(SKETCH, np.int64)
    space = _SPACE[buf]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(SKETCH, np.int64)
    if (end - start).max() > LONG:
        start, end = _by_characters(buf, start, end)
    r = _rolling()
    with np.errstate(over="ignore"):
        words = r.spans(r.prefix(buf), start, end)
        line = np.cumsum(buf == 10)[start]
        same = line[1:] == line[:-1]
        pairs = common.mix(words[:-1] * np.uint64(3) + words[1:])[same]
        alone = np.ones(len(words), bool)
        alone[1:] &= ~same
        alone[:-1] &= ~same
        # a shingle and its paragraph; the first of each kind is kept
        h, of = np.concatenate([pairs, words[alone]]), np.concatenate([line[1:][same], line[alone]]).astype(np.uint64)
        h = h[np.unique(common.mix(h + of * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]] if len(h) > 1 else h
    sign = 1 - 2 * (h >> np.uint64(63)).astype(np.int64)
    return np.bincount((h % np.uint64(SKETCH)).astype(np.int64), weights=sign, minlength=SKETCH).astype(np.int64)


def _by_characters(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, but of long ones each character."""
    first = (buf & 0xC0) != 0x80  # of a character in UTF-8
    inside = np.zeros(len(buf) + 1, np.int8)
    long = end - start > LONG
    np.add.at(inside, start[long], 1)
    np.add.at(inside, end[long], -1)
    chars = np.flatnonzero(first & (np.cumsum(inside[:-1]) > 0))
    starts = np.sort(np.concatenate([start[~long], chars]))
    bounds = np.sort(np.concatenate([end, chars]))  # a character ends where the next begins, or its word
    return starts, bounds[np.searchsorted(bounds, starts, side="right")]


class Fingerprint:
    """Lanes of a multiset of paragraphs."""

    def __init__(self, wide: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.wide = np.zeros(WIDE, np.uint64) if wide is None else wide
        self.sketch = np.zeros(SKETCH, np.int64) if sketch is None else sketch

    @classmethod
    def of(cls, text: bytes) -> Fingerprint:
        out = cls(sketch=sketch_lanes(np.frombuffer(text, np.uint8)))
        if text:
            lanes = b"".join(hashlib.shake_128(p).digest(8 * WIDE) for p in text.split(b"\n"))
            out.wide = np.frombuffer(lanes, "<u8").reshape(-1, WIDE).sum(0, dtype=np.uint64)
        return out

    def _change(self, paragraph: bytes, sign: int) -> Fingerprint:
        one = Fingerprint.of(paragraph)
        with np.errstate(over="ignore"):
            return Fingerprint(self.wide + one.wide if sign > 0 else self.wide - one.wide, self.sketch + sign * one.sketch)

    def insert(self, paragraph: bytes) -> Fingerprint:
        return self._change(paragraph, 1)

    def delete(self, paragraph: bytes) -> Fingerprint:
        return self._change(paragraph, -1)

    def text(self) -> str:
        folded = ((self.sketch << 1) ^ (self.sketch >> 63)).astype("<i8").view(np.uint8).reshape(-1, 8)
        low = zlib.compress(folded.T.tobytes(), 1)
        return self.wide.astype("<u8").tobytes().hex() + ":" + base64.b64encode(low).decode()

    @classmethod
    def parse(cls, value: str) -> Fingerprint:
        wide, low = value.split(":")
        planes = np.frombuffer(zlib.decompress(base64.b64decode(low)), np.uint8).reshape(8, -1)
        folded = np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)
        sketch = (folded >> np.uint64(1)).astype(np.int64) ^ -(folded & np.uint64(1)).astype(np.int64)
        return cls(np.frombuffer(bytes.fromhex(wide), "<u8").astype(np.uint64), sketch)


def _dot(a: np.ndarray, b: np.ndarray) -> int:
    """Exact: whole numbers of any size where 64 bits might not hold the sum."""
    if max(-int(a.min()), int(a.max()), -int(b.min()), int(b.max())) < 1 << 27:
        return int(a @ b)
    return sum(x * y for x, y in zip(a.tolist(), b.tolist(), strict=True))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    if np.array_equal(a.wide, b.wide):
        return 1.0
    x, y = a.sketch, b.sketch
    total = _dot(x, x) + _dot(y, y)
    if not total:
        return 0.0
    return float(min(1.0, max(0.0, 2 * _dot(x, y) / total)))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many, or all, of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(text: str, print_: Fingerprint, following: str, next_print: Fingerprint) -> tuple:
    other = edited(text, following)
    raw = other.encode("utf-8", "surrogatepass")
    changed = Fingerprint.of(raw)
    return len(text), hashlib.sha256(raw).hexdigest(), print_.text(), changed.text(), likeness(print_, changed), likeness(print_, next_print)


OUT = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]


def fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fingerprint`` of each whole text; nothing is shuffled."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            prints = [Fingerprint.of(bytes(v)).text() for v in common.binary_views(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != at), pa.array(prints, pa.string())], names=schema.names)

    return docs.select(*(F.col(c) for c in keep), common.utf8(text).alias("__text")).mapInArrow(common.released(run), schema)


def compare_with_next(docs: DataFrame, text: str = "text", id_col: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """``id_col`` and the columns OUT of each row against the row that follows it by id.

    Rows are dealt out by ranges of the id and sorted within them, which moves each text once.  Within a partition
    the next row is at hand.  A partition also passes on its first and its last text; these few rows, two a
    partition, are joined in a second step, the last partition with the first.
    """
    spark = common.session_of(docs)
    common.tidy(spark)
    id_type = docs.schema[id_col].dataType
    out = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("id", id_type), T.StructField("text", T.StringType()), *(T.StructField(n, t) for n, t in OUT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, first, rows = TaskContext.get().partitionId(), None, None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in batches:
            ids = batch.column(0)
            for i, value in enumerate(batch.column(1)):
                now = value.as_py() or ""
                print_ = Fingerprint.of(now.encode("utf-8", "surrogatepass"))
                if last is not None:
                    rows.append((part, 0, last[0], None, *_row(last[1], last[2], now, print_)))
                else:
                    first = now
                last = (ids[i].as_py(), now, print_)
                if len(rows) >= 200:
                    yield batch_of(rows)
                    rows = []
        if last is not None:
            rows += [(part, 1, None, first, *[None] * len(OUT)), (part, 2, last[0], last[1], *[None] * len(OUT))]
        if rows:
            yield batch_of(rows)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    n = partitions or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).withColumn("digest", F.unhex(F.md5("text"))).repartitionByRange(n, "id", "digest").sortWithinPartitions("id", "digest").drop("digest")
    made = common.written(dealt.mapInArrow(common.released(run), out), "fingerprints")
    names = [F.col("id").alias(id_col), *(F.col(c) for c, _ in OUT)]
    inner = made.where("kind = 0").select(*names)
    # which partition follows which: a few bytes for each partition that has rows
    parts = sorted(r.part for r in made.where("kind = 1").select("part").collect())
    following = spark.createDataFrame([(a, b) for a, b in zip(parts, parts[1:] + parts[:1], strict=True)], "part int, after int")
    heads = made.where("kind = 1").select(F.col("part").alias("after"), F.col("text").alias("following"))
    tails = made.where("kind = 2").select("part", "id", "text").join(F.broadcast(following), "part").join(heads, "after").select("id", "text", "following")
    edge = T.StructType([T.StructField("id", id_type), *(T.StructField(n, t) for n, t in OUT)])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                a, b = batch.column(1)[i].as_py() or "", batch.column(2)[i].as_py() or ""
                rows.append((batch.column(0)[i].as_py(), *_row(a, *(Fingerprint.of(a.encode("utf-8", "surrogatepass")), b, Fingerprint.of(b.encode("utf-8", "surrogatepass"))))))
            if rows:
                schema = to_arrow_schema(edge)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return inner.unionByName(tails.mapInArrow(common.released(edges), edge).select(*names))
