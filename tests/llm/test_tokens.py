from __future__ import annotations

import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomspark.llm import byte_bpe, token_counts

from . import data

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_LEVEL = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

AWKWARD = [
    None, "", " ", "   ", "\n", " \n x", "a  b   c\t\td \n\n e", "<|endoftext|>", "x<|startoftext|>y <|endoftext|>", "don't I'LL we've'd", "12 345 6789 ½ Ⅷ",
    "漢字かな交じり文 텍스트", "é é ﬁ ǅ İ ß", " nb　sp line\u0085nel\x1cfs\x0bvt", "​zero﻿width", "😀👩‍👩‍👧 🇩🇪", "\x00\x01\x7f", "A" * 5000, "ab" * 3000, "!?" * 999, " " * 4000 + "end", "end" + " " * 4000,
    "tab\tnew\r\nline", "à" * 50, "x " * 20000, "</w> a</w>", "�",
]


def noise(seed: int) -> list[str]:
    r = random.Random(seed)
    pool = "abz AZ09 \t\n'’.,é漢😀 　_-<|>ßÍ"
    return ["".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(400)]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(list(enumerate(AWKWARD + noise(4))), "doc_id long, text string")
    return made.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text")).unionByName(made.limit(3)).cache()


def test_counts_as_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_LEVEL)
    t.no_truncation()
    t.no_padding()
    got = token_counts.with_limit(token_counts.count_tokens(docs, WORD_LEVEL)).join(docs.distinct(), "doc_id").collect()
    for r in got:
        n = len(t.encode(r.text or "", add_special_tokens=False))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 2048), (r.doc_id, r.text)


def test_where_texts_may_be_split(tmp_path):
    import json

    assert token_counts.splits_at_spaces(WORD_LEVEL) and not token_counts.splits_at_spaces(PIECES)
    with open(WORD_LEVEL, encoding="utf-8") as f:
        made = json.load(f)
    changes = {
        "keeps": {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
        "none": {"pre_tokenizer": None},
        "spaces": {"pre_tokenizer": {"type": "Split", "pattern": {"Regex": " ?\\p{L}+"}, "behavior": "Removed", "invert": True}},
        "adds": {"normalizer": {"type": "Prepend", "prepend": "x"}},
        "token": {"added_tokens": [{**made["added_tokens"][0], "content": "two words"}]},
    }
    for name, change in changes.items():
        (at := tmp_path / f"{name}.json").write_text(json.dumps(made | change), encoding="utf-8")
        assert not token_counts.splits_at_spaces(str(at)), name
    (at := tmp_path / "bert.json").write_text(json.dumps(made | {"pre_tokenizer": {"type": "BertPreTokenizer"}}), encoding="utf-8")
    assert token_counts.splits_at_spaces(str(at))


def test_counts_of_pieces(spark, docs):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    few = docs.where("doc_id < 10050")
    for r in token_counts.count_tokens(few, PIECES).join(few.distinct(), "doc_id").collect():
        assert r.n_tokens == len(m.encode(r.text or "")), r.text


def test_ids_as_the_library(spark, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    made = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    for r in byte_bpe.decode(made, RANKS).join(docs.distinct(), "doc_id").collect():
        ids = enc.encode_ordinary(r.text or "")
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(r.ids) == raw and r.n_tokens == len(ids), (r.doc_id, r.text)
        assert r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert bytes(r.decoded) == (r.text or "").encode() and r.decoded_sha256 == hashlib.sha256(bytes(r.decoded)).hexdigest()


def test_clashing_names_and_empty_tables(spark):
    docs = data.table(spark, extra=True)
    assert byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, with_ids=False).count() == docs.count()
    assert token_counts.count_tokens(docs, WORD_LEVEL).count() == docs.count()
    assert byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(docs.limit(0), WORD_LEVEL).count() == 0
