"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split at ASCII white space where the tokenizer allows it: its pre-tokenizer drops white space, its normaliser
joins nothing over it and adds nothing to a text, and no added token holds any (``splits_at_spaces`` reads its file).
Then the counts of the parts add up to the count of the text, however long it is; else whole texts are encoded.
The library encodes each distinct part of a batch once, in calls balanced by bytes; what comes back is a
length, kept in a table of bounded size that each Python worker carries from batch to batch.

Defined cases: a null text counts as empty (0 tokens); rows that repeat give one result each; an empty table
gives an empty result; other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SPACES = " \t\n\r\x0b\x0c"
#: Bytes of text in one call of the library; distinct parts kept by a worker between batches.
CALL_BYTES, KEPT_PARTS = 1 << 18, 600_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda parts: [len(x) for x in model.encode(parts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    batch = getattr(t, "encode_batch_fast", t.encode_batch)  # the fast one leaves out offsets
    return lambda parts: [len(x) for x in batch(parts, add_special_tokens=False)]


def splits_at_spaces(path: str) -> bool:
    """Whether white space never carries nor joins tokens of this vocabulary, so that texts may be cut there."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        made = json.load(f)

    def steps(part: dict | None, inner: str) -> list[dict]:
        return [] if not part else [y for x in part[inner] for y in steps(x, inner)] if part["type"] == "Sequence" else [part]

    def drops(step: dict) -> bool:
        if step["type"] in ("BertPreTokenizer", "Whitespace", "WhitespaceSplit"):
            return True
        # what does not match is removed, and nothing that matches has white space in it
        pattern = step.get("pattern", {}).get("Regex", "")
        if step["type"] != "Split" or not step.get("invert") or step.get("behavior") != "Removed" or not pattern:
            return False
        import regex

        return not any(regex.search(pattern, a + s + b) and any(set(m.group()) & set(SPACES) for m in regex.finditer(pattern, a + s + b)) for s in SPACES for a in ("", "a", "1", ".", "'", s) for b in ("", "a", "1", ".", s))

    def joins_nothing(step: dict) -> bool:
        if step["type"] == "Replace":
            return step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "
        return step["type"] in ("NFC", "NFD", "Lowercase", "BertNormalizer", "StripAccents")

    pre = steps(made.get("pre_tokenizer"), "pretokenizers")
    whole = not any(set(t["content"]) & set(SPACES) or t.get("single_word") for t in made.get("added_tokens") or [])
    return bool(pre) and drops(pre[0]) and all(joins_nothing(x) for x in steps(made.get("normalizer"), "normalizers")) and whole


def balanced(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``limit`` bytes each."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


class Counter:
    """Lengths of parts; remembers those it has seen, between ``kept`` / 2 and ``kept`` of them, the latest first."""

    def __init__(self, path: str, call_bytes: int = CALL_BYTES, kept: int = KEPT_PARTS):
        self.lengths, self.call_bytes, self.kept = _tokenizer(path), call_bytes, kept
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def of(self, parts: list[str]) -> np.ndarray:
        out = [self.known.get(p, -1) for p in parts]
        new = [i for i, n in enumerate(out) if n < 0]
        if new and self.older:
            for i in new:
                if (n := self.older.get(parts[i], -1)) >= 0:
                    out[i] = self.known[parts[i]] = n
            new = [i for i in new if out[i] < 0]
        if len(self.known) + len(new) > self.kept // 2:
            self.known, self.older = {}, self.known
        if new:
            fresh = [parts[i] for i in new]
            sizes = pc.binary_length(pa.array(fresh, pa.large_string())).to_numpy() + 16
            got: list[int] = []
            for a, b in balanced(sizes, self.call_bytes):
                got += self.lengths(fresh[a:b])
            for i, n in zip(new, got, strict=True):
                out[i] = n
            if len(fresh) <= self.kept // 2:
                self.known.update(zip(fresh, got, strict=True))
        return np.array(out, np.int64)


def counts_of_batch(texts: pa.Array, counter: Counter, splits: bool) -> np.ndarray:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not splits:  # white space carries tokens: whole texts are encoded
        return counter.of(texts.to_pylist())
    parts = pc.ascii_split_whitespace(texts)
    offsets = parts.offsets.to_numpy()
    coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    lengths = counter.of(coded.dictionary.to_pylist())
    each = lengths[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])
    at = offsets - offsets[0]
    return total[at[1:]] - total[at[:-1]]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rows: int = 512) -> DataFrame:
    """``keep`` columns, ``n_bytes`` and ``n_tokens`` of each whole text.

    ``vocabulary`` is the path of a tokenizers .json or a sentencepiece .model file, the same on every
    machine.  A .model, where white space becomes part of the pieces, encodes whole texts.
    """
    splits = splits_at_spaces(vocabulary)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in balanced(sizes + 64, 1 << 24):
                part = batch.slice(a, b - a)
                n = counts_of_batch(part.column(at), counter, splits)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns) if i != at), pa.array(sizes[a:b]), pa.array(n, pa.int64())], names=[*keep, "n_bytes", "n_tokens"])

    common.tidy(common.session_of(docs))
    return docs.select(*(F.col(c) for c in keep), F.col(text).alias("__text")).mapInArrow(common.released(count), schema)


def with_limit(counted: DataFrame, limit: int = 2048) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
