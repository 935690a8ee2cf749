"""Helpers shared by the text operators: row keys, written tables, byte buffers, rolling hashes.

Every operator identifies a row by ``row_key``: 128 bits of its id and its text.  Two rows that share
both are the same row twice and get the same answer, so no generated id is needed and a task that is run
again on another executor gives the same keys.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written  # noqa: F401


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def tidy(spark: SparkSession) -> None:
    """Three settings of the session, for good, where its user has not chosen them: each finished query drops its shuffle
    files at once instead of at some later garbage collection, and Python is handed as many rows and bytes at a time as the
    operators work on (larger Arrow batches are only held in memory, twice).  Plans are run after the operators return, so the
    settings can't be put back by them."""
    chosen = spark.sparkContext.getConf()
    for name, value in (("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "1024"), ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")):
        if not chosen.contains(name):
            spark.conf.set(name, value)


Batches = Iterator[pa.RecordBatch]


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, and then the memory that Arrow and the C library keep for later back to the system: the worker is idle while
    the next stages need it, or runs them."""

    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


def row_key(text: str = "text", id_col: str = "doc_id") -> Column:
    """16 bytes; the id's length keeps it apart from the text, and a null is no empty text."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    size = F.coalesce(F.length(F.col(id_col).cast("string")), F.lit(-1)).cast("string")
    return F.unhex(F.md5(F.concat(size, F.lit(":"), name, F.when(F.col(text).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(text))))))


def utf8(text: str = "text") -> Column:
    """Text as bytes; null is empty."""
    return F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column computed once a row.  The optimizer writes the expression of a plain column into the
    lambda functions that use it, where it is computed anew for each element; it leaves the one row of a generator be."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def binary_views(col: pa.Array) -> Iterator[np.ndarray]:
    """Each value of a binary or string Arrow array as a byte array, without a copy; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        width = np.int32
    else:
        width = np.int64
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, dtype=width)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = None if col.null_count == 0 else col.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(col)):
        yield buf[off[i] : off[i + 1]] if valid is None or valid[i] else buf[:0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a public-domain avalanche step)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


class Rolling:
    """Polynomial hashes of substrings modulo 2**64, over bytes mapped to random 64-bit values first.

    ``prefix`` costs a few vector operations a byte; ``spans`` then hashes any substrings at once.
    """

    def __init__(self, seed: int):
        r = np.random.RandomState(seed)
        draw = lambda n: r.randint(0, 1 << 32, n, dtype=np.uint64) << np.uint64(32) | r.randint(0, 1 << 32, n, dtype=np.uint64)
        self.values = draw(256)
        base = int(draw(1)[0]) | 1 | 4
        base = base - (base % 8) + 5  # odd, of the largest order
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 14)
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, self.base, np.uint64)]))
                self.down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, self.inverse, np.uint64)]))

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        self._grow(len(buf) + 1)
        out = np.empty(len(buf) + 1, np.uint64)
        out[0] = 0
        np.cumsum(self.values[buf] * self.up[: len(buf)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        n = len(prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((prefix[width:] - prefix[:n]) * self.down[:n] + np.uint64(width))
