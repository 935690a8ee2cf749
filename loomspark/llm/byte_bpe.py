"""Byte-level BPE encoding and decoding.

The distinct words of each Arrow batch are encoded by folding the ranked merges over their bytes: the pair of
neighbours with the lowest rank in the rank map joins, until no pair of neighbours has a rank.  The ids of a
text are the ids of its words in order; decoding looks every id up again and concatenates the binary pieces.

The fold runs in Python on the executors, over the distinct words of a batch, and not in SQL higher-order
functions: a literal map of 50,000 ranks is searched from end to end at each look-up there, and dealing out
the words of all texts to join them with the encoded words moves several times the input over the network.

Defined cases: a null text is empty (no ids); repeated rows give one result each; an empty table gives an empty
result; a word of any length is encoded whole (the neighbours are kept in a heap, so that time grows with
n log n); white space, control characters and lone surrogates cannot fail, as every byte has a rank.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .token_counts import balanced

#: Distinct words that a worker keeps between batches.
KEPT_WORDS = 200_000


@lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: merge the leftmost pair of the lowest rank again and again."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 64:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    none = 1 << 60
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a linked list and a heap."""
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        a = parts[i]
        j = after[i]
        if a is None or j >= n or len(a) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = a + parts[j], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n:
                pair = parts[k] + parts[after[k]]
                r = ranks.get(pair)
                if r is not None:
                    heapq.heappush(heap, (r, k, len(pair)))
    return [ranks[p] for p in parts if p is not None]


#: A space with white space behind it: such texts are cut into words as a whole.
UNEVEN = " [\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each of the ranges, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Texts to little-endian 32-bit ids and back.

    A text is first cut before its single spaces, where no word of the pattern goes across; each distinct unit
    of a batch is then cut into words and folded once, and kept for the next batches."""

    def __init__(self, path: str, pattern: str, kept: int = KEPT_WORDS):
        import regex

        self.ranks, self.words, self.kept = ranks_of(path), regex.compile(pattern), kept
        self.memory: dict[str, list[dict[str, bytes]]] = {"words": [{}, {}], "units": [{}, {}]}
        pieces: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for piece, i in self.ranks.items():
            pieces[i] = piece
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def _recall(self, kind: str, names: set[str]) -> tuple[dict[str, bytes], set[str]]:
        """What is known, and which names are new; a table that is full becomes the older one of two."""
        known, older = self.memory[kind]
        if len(known) > self.kept // 2:
            known, older = self.memory[kind] = [{}, known]
        new = names.difference(known)
        if older:
            for n in [n for n in new if n in older]:
                known[n] = older[n]
                new.discard(n)
        return known, new

    def _fold_all(self, words: set[str]) -> dict[str, bytes]:
        known, new = self._recall("words", words)
        for w in new:
            ids = fold(w.encode("utf-8", "surrogatepass"), self.ranks)
            known[w] = struct.pack(f"<{len(ids)}I", *ids)
        return known

    def encode(self, text: str) -> bytes:
        words = self.words.findall(text)
        return b"".join(map(self._fold_all(set(words)).__getitem__, words))

    def _spaced(self, units: list[str]) -> list[bytes]:
        """Ids of each unit with a space in front."""
        known, new = self._recall("units", set(units))
        for unit in [u for u in new if not u or u[0].isspace()]:  # the empty one, and those that only begin texts
            known[unit] = self.encode(" " + unit)
            new.discard(unit)
        if new:
            order = list(new)
            words = self.words.findall(" " + " ".join(order))
            folded = self._fold_all(set(words))
            ids = [folded[w] for w in words]
            first = [i for i, w in enumerate(words) if w[0] == " "] + [len(words)]
            for unit, a, b in zip(order, first[:-1], first[1:], strict=True):
                known[unit] = ids[a] if b == a + 1 else b"".join(ids[a:b])
        return [known[u] for u in units]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        whole = {int(i): self.encode(texts[int(i)].as_py()) for i in np.flatnonzero(uneven)}
        if whole:
            texts = pc.if_else(pa.array(uneven), pa.scalar("", pa.large_string()), texts)
        parts = pc.split_pattern(texts, " ")
        off = parts.offsets.to_numpy()
        off = off - off[0]
        coded = parts.flatten().dictionary_encode()
        units, source = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = [whole[i] if i in whole else self.encode(units[source[a]]) for i, a in enumerate(off[:-1])]
        found = self._spaced(units) + firsts
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        source[off[:-1]] = len(units) + np.arange(len(firsts))
        ids = flat[ranges((np.cumsum(size) - size)[source], size[source])]
        ends = np.concatenate([[0], np.cumsum(size[source])])
        return ids, ends[off[1:]] - ends[off[:-1]]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids: their pieces concatenated."""
        return self.bytes[ranges(self.start[ids], self.size[ids])]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """``keep`` columns, ``ids`` (binary, little-endian unsigned 32-bit; left out if not ``with_ids``),
    ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, the digest of the bytes that the ids decode to."""
    extra = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([*(docs.schema[c] for c in keep), *([T.StructField("ids", T.BinaryType())] if with_ids else []), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(vocabulary, pattern)
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in balanced(sizes + 64, 1 << 21):
                part = batch.slice(a, b - a)
                all_ids, n = enc.encode_batch(part.column(at))
                ends = np.concatenate([[0], np.cumsum(n)])
                ids, digest, decoded = [], [], []
                for x, y in zip(ends, ends[1:], strict=False):
                    own = all_ids[x:y]
                    if with_ids:
                        ids.append(own.tobytes())
                    digest.append(hashlib.sha256(own.tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(enc.decode(own).tobytes()).hexdigest())
                cols = [*(part.column(i) for i in range(part.num_columns) if i != at), *([pa.array(ids, pa.binary())] if with_ids else []), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
            pa.default_memory_pool().release_unused()

    common.tidy(common.session_of(docs))
    return docs.select(*(F.col(c) for c in keep), F.col(text).alias("__text")).mapInArrow(common.released(run), schema)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``decoded`` binary: the pieces of ``ids`` concatenated.  Null ids decode to null, an unknown id fails."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {i: p for p, i in ranks_of(vocabulary).items()}
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            out = [None if not v.is_valid else b"".join(pieces[i] for i in np.frombuffer(v.as_py(), "<u4").tolist()) for v in col]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return encoded.mapInArrow(common.released(run), schema)
