"""Token ids as Parquet files: written in document order, read back by row, by range of the stream, or without ids.

``write_tokens`` deals documents out by ranges of their id, sorts within them, encodes whole texts in Arrow functions, and lets
Spark write one file a range (with its commit protocol, so lost executors leave no half of one).  A folder holds

* ``tokens``: part, doc_id, offset (ids before the document in its part), n_tokens, ids (a list column).  Ids are dictionary
  encoded (a vocabulary's ids fit one dictionary, so an id takes as many bits as there are kinds of ids), the sorted columns are
  delta encoded; row groups and pages are of a stated size, and pages have an index, so readers skip what they don't ask for;
* ``parts``: part, base (ids before it in the whole stream) and n_tokens: one row a file, from the metadata columns alone.

The place of a document in the stream is base + offset: no pass over all documents in one task is needed to know it.

Whole texts are encoded, but not each word anew: where the tokenizer's file shows that its words never reach over certain
bounds (before white space that follows a visible character; before ``,.;:!?)`` after an ASCII letter), texts are cut there, and
each kind of part is encoded once by the library and kept in a table of bounded size.  Other tokenizers get whole texts.

Defined cases: a null text is empty and has only the end id; null document ids come first; rows with one id are ordered by the
digest of their text, and rows that repeat wholly follow each other; an empty table gives empty files and rows; texts of any length
are encoded whole (the library's own memory holds a part without bounds, such as a long text without white space, at once); other
columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, token_counts

#: Bytes of a row group, of a page, and rows of a page.
GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 1024
#: Bytes of text that are encoded together; kinds of parts that a worker keeps; bytes of one call of the library.
BLOCK_BYTES, KEPT_PARTS, CALL_BYTES = 12 << 20, 800_000, 1 << 18
#: Marks that always begin a new word after a letter.
MARKS = ",.;:!?)"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return getattr(t, "encode_batch_fast", t.encode_batch)


def cuts_of(path: str) -> str | None:
    """The marks before which texts may be cut (white space always is), or None if only whole texts may be encoded: the
    tokenizer must split by the byte-level rule, change nothing before it, add nothing, and have no added token over a cut."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    pre, post = made.get("pre_tokenizer") or {}, made.get("post_processor")
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not made.get("normalizer") and (not post or post.get("type") == "ByteLevel")
    added = made.get("added_tokens") or []
    if not plain or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t["content"].split() != [t["content"]] for t in added):
        return None
    return "".join(m for m in MARKS if not any(m in t["content"] for t in added))


def parts_of(buf: np.ndarray, firsts: np.ndarray, marks: str) -> np.ndarray:
    """Where the parts of these bytes begin; ``firsts``: where texts do.  After a character of two bytes (none of U+00C0 and
    above is white space) texts are cut as after ASCII; after longer ones they are not."""
    if not len(buf):
        return np.zeros(0, np.int64)
    mark = np.zeros(256, bool)
    mark[list(marks.encode())] = True
    stops = np.flatnonzero((_SPACE | mark)[buf[1:]]) + 1  # few of the bytes; what stands before them decides
    own, before, further = buf[stops], buf[stops - 1], buf[np.maximum(stops - 2, 0)]
    seen = (before > 32) & (before < 127) | (before >= 0x80) & (further >= 0xC3) & (further < 0xE0) & (stops > 1)
    cut = np.zeros(len(buf), bool)
    cut[stops[_SPACE[own] & seen | mark[own] & _LETTER[before]]] = True
    cut[firsts[firsts < len(buf)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts, by parts; remembers those it has encoded, between ``kept`` / 2 and ``kept`` of them, the latest first."""

    def __init__(self, path: str, kept: int = KEPT_PARTS):
        self.encode, self.marks, self.kept = _tokenizer(path), cuts_of(path), kept
        self.known: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])
        self.older: tuple[dict[str, int], np.ndarray, np.ndarray] = ({}, np.zeros(0, np.int32), np.zeros(1, np.int64))

    def _add(self, parts: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        self.known.update(zip(parts, range(len(self.ends) - 1, len(self.ends) - 1 + len(parts)), strict=True))
        self.ends.frombytes((len(self.flat) + np.cumsum(n)).astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.int32).tobytes())

    def _learn(self, kinds: list[str]) -> None:
        new = [p for p in kinds if p not in self.known]
        if len(self.known) + len(new) > self.kept // 2 and self.known:
            self.older = self.known, np.array(self.flat, np.int32), np.array(self.ends, np.int64)
            self.known, self.flat, self.ends, new = {}, array("i"), array("q", [0]), kinds
        held, flat, ends = self.older
        if held:
            again = [p for p in new if p in held]
            at = np.fromiter(map(held.__getitem__, again), np.int64, len(again))
            n = ends[at + 1] - ends[at]
            self._add(again, flat[np.repeat(ends[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n)
            new = [p for p in new if p not in held]
        for a, b in token_counts.balanced(np.fromiter(map(len, new), np.int64, len(new)) * 2 + 16, CALL_BYTES):
            ids = [e.ids for e in self.encode(new[a:b], add_special_tokens=False)]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            self._add(new[a:b], np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())), n)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        buf, firsts = np.concatenate([*common.binary_views(texts), np.zeros(0, np.uint8)]), np.cumsum(sizes) - sizes
        starts = np.unique(firsts[sizes > 0]) if self.marks is None else parts_of(buf, firsts[sizes > 0], self.marks)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        offsets = np.append(starts, len(buf)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf)]).dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        self._learn(kinds)
        flat, ends = np.frombuffer(self.flat, np.int32), np.frombuffer(self.ends, np.int64)
        at = np.fromiter(map(self.known.__getitem__, kinds), np.int64, len(kinds))[coded.indices.to_numpy()]
        n = np.diff(ends).astype(np.int32)[at]
        total = np.cumsum(n, dtype=np.int32)
        places = np.repeat(ends.astype(np.int32)[at] - (total - n), n)
        places += np.arange(len(places), dtype=np.int32)
        ids = flat[places]
        del flat, ends  # else the arrays can't grow
        upto = np.append(0, total)
        at_text = np.searchsorted(starts, np.append(firsts, len(buf)))
        return ids, upto[at_text[1:]] - upto[at_text[:-1]]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One a worker, which goes on with the parts it knows from task to task."""
    return Encoder(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together, up to ``BLOCK_BYTES``; a larger one stays as it is."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _order(id_col: str, text: str) -> list[Column]:
    return [F.asc_nulls_first(id_col), F.asc(F.xxhash64(text)), F.asc(F.md5(common.utf8(text)))]


def write_tokens(docs: DataFrame, tokenizer: str, at: str, end: int = 0, id_col: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Write the ids of each whole text, and ``end`` after each, to the folder ``at`` in ascending order of ``id_col``."""
    schema = T.StructType([T.StructField("part", T.IntegerType(), False), T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType(), False) for c in ("offset", "n_tokens")), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, done = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for block in _blocks(batches):
            ids, n = encoder.of(block.column(1))
            ids, n = np.insert(ids, np.cumsum(n), end), n + 1
            ends = np.append(0, np.cumsum(n))
            for a in range(0, len(n), PAGE_ROWS):
                z = min(a + PAGE_ROWS, len(n))
                lists = pa.ListArray.from_arrays(pa.array((ends[a : z + 1] - ends[a]).astype(np.int32)), pa.array(ids[ends[a] : ends[z]], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(z - a, part, np.int32)), block.column(0).slice(a, z - a), pa.array(done + ends[a:z]), pa.array(n[a:z]), lists], names=schema.names)
            done += int(ends[-1])

    spark = common.session_of(docs)
    common.tidy(spark)
    order = _order(id_col, text)
    dealt = docs.select(F.col(id_col), F.col(text)).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    rows = dealt.select(F.col(id_col).alias("doc_id"), common.utf8(text).alias("text")).mapInArrow(common.released(encode), schema)
    settings = {"compression": "snappy", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": group_bytes, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": page_rows}
    for name in ("part", "doc_id", "offset", "n_tokens"):
        settings[f"parquet.enable.dictionary#{name}"] = "false"
    rows.write.options(**settings).parquet(f"{at}/tokens")
    sums = metadata(spark, at).groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))  # one row a file from here on
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums.select("part", base.alias("base"), "n_tokens").write.parquet(f"{at}/parts")


def metadata(spark: SparkSession, at: str) -> DataFrame:
    """part, doc_id, offset and n_tokens of each document: the ids are not read."""
    return spark.read.parquet(f"{at}/tokens").select("part", "doc_id", "offset", "n_tokens")


def tokens(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids; filters on doc_id reach the pages' index."""
    rows, parts = spark.read.parquet(f"{at}/tokens"), spark.read.parquet(f"{at}/parts").select("part", "base")
    return rows.join(parts, "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def stream_range(spark: SparkSession, at: str, begin: int, end: int) -> DataFrame:
    """doc_id, start and ids of what lies in [begin, end) of the whole stream, the ids of documents on its edges cut.  The
    parts that reach in are known from one row a file; each file is asked by the offsets that are left of the range."""
    parts = spark.read.parquet(f"{at}/parts").where((F.col("base") < end) & (F.col("base") + F.col("n_tokens") > begin))
    first = parts.agg(F.min("part"), F.max("part")).first()
    if first[0] is None:
        return tokens(spark, at).where(F.lit(False)).select("doc_id", "start", "ids")
    rows = spark.read.parquet(f"{at}/tokens").where(F.col("part").between(first[0], first[1])).join(parts.select("part", "base"), "part")
    start = F.col("base") + F.col("offset")
    inside = rows.where((start < end) & (start + F.col("n_tokens") > begin))
    left = F.greatest(F.lit(0), F.lit(begin) - start)
    right = F.least(F.col("n_tokens"), F.lit(end) - start)
    return inside.select("doc_id", (start + left).alias("start"), F.slice("ids", (left + 1).cast("int"), (right - left).cast("int")).alias("ids"))


def summaries(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers), all from the files."""
    rows = spark.read.parquet(f"{at}/tokens")
    schema = T.StructType([rows.schema["part"], rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("offset", "n_tokens", "ids_crc32"))])

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], names=schema.names)

    common.tidy(spark)
    made = rows.select("part", "doc_id", "ids", "offset").mapInArrow(common.released(crc), schema)
    parts = spark.read.parquet(f"{at}/parts").select("part", "base")
    return made.join(parts, "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
