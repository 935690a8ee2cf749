from __future__ import annotations

import glob
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomspark.llm import queries, token_files

from . import data
from .test_tokens import AWKWARD, noise

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def expected(library, rows, end=0):
    """doc_id, start, n, crc of (doc_id, text) in the order given."""
    out, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_parts_give_what_whole_texts_give(library):
    r = random.Random(5)
    pool = ["é", "È,", "×,", "漢。 ", "a,b", "a)", "x<|endoftext|>y", "<|endoftext|>", " ", "  ", "\n", "\r\n", "\t", " ", "　", " x", "' ll", "I'll", "don't.", "12,5", "12 ,", "a\x0b", "\x1c", "\x7f ", "ñ\n\n", "ß!!", "?!", "...", "\u0085 ", "z", "Ab", "߷ ", "ࠀ ", "😀 "]
    texts = [t or "" for t in AWKWARD + noise(9)] + ["".join(r.choices(pool, k=r.randrange(30))) for _ in range(1500)]
    ids, n = token_files.Encoder(BYTES).of(pa.array([t.encode() for t in texts], pa.binary()))
    at = np.append(0, np.cumsum(n))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_cuts_are_read_from_the_file(tmp_path):
    import json

    made = json.load(open(BYTES))
    assert token_files.cuts_of(BYTES) == ",.;:!?)"
    for change, want in (({"added_tokens": [{"content": "<,>"}]}, ".;:!?)"), ({"added_tokens": [{"content": "a b"}]}, None), ({"added_tokens": [{"content": "a", "lstrip": True}]}, None), ({"normalizer": {"type": "NFC"}}, None), ({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, None)):
        (tmp_path / "t.json").write_text(json.dumps(made | change))
        assert token_files.cuts_of(str(tmp_path / "t.json")) == want
    assert token_files.cuts_of(public_tokenizers.path("word_bpe_49k.json")) is None


def test_few_kept_parts(library):
    """A worker that forgets gives the same."""
    e = token_files.Encoder(BYTES, kept=20)
    for seed in range(4):
        texts = noise(seed)[:60]
        ids, n = e.of(pa.array([t.encode() for t in texts], pa.binary()))
        assert ids.tolist() == [x for t in texts for x in library.encode(t, add_special_tokens=False).ids]


def key(row):
    return (row[0] is not None, row[0] or 0)


def test_files_as_the_library_encodes(spark, library, tmp_path):
    rows = [(i, t) for i, t in enumerate(AWKWARD + noise(2)[:100])] + [(r[0] and r[0] + 1000, r[1]) for r in data.rows()] + [(7777, "word " * 150_000), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("ids"), F.lit(2).alias("part"), F.lit(3).alias("offset")).repartition(6)
    at = str(tmp_path / "t")
    token_files.write_tokens(docs, BYTES, at)
    got = sorted(map(tuple, token_files.summaries(spark, at).collect()), key=lambda x: x[1])
    assert [x[0] for x in got] == [x[0] for x in sorted(rows, key=key)]
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(t)
    # rows of one id in any order: their counts and sums are the same set, and the starts follow each other
    assert [x[1] for x in got] == list(np.append(0, np.cumsum([x[2] for x in got]))[:-1])
    assert sorted((x[0] or -1, x[2], x[3]) for x in got) == sorted((x[0] or -1, x[2], x[3]) for x in expected(library, rows))
    whole = {(x[0], x[2], x[3]) for x in got}
    assert len(got) == len(rows) and whole

    # files: encodings, row groups, pages' index, order
    kinds = set()
    for f in glob.glob(f"{at}/tokens/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                kinds.add((col.path_in_schema.split(".")[0], tuple(sorted(set(col.encodings) - {"RLE", "PLAIN", "BIT_PACKED"}))))
                assert col.has_column_index and col.has_offset_index
        ids = pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert ("ids", ("RLE_DICTIONARY",)) in kinds and ("doc_id", ("DELTA_BINARY_PACKED",)) in kinds and ("offset", ("DELTA_BINARY_PACKED",)) in kinds

    # selective reads
    plan = token_files.tokens(spark, at).where("doc_id = 12")
    assert plan.first().ids == [*library.encode(AWKWARD[12] or "", add_special_tokens=False).ids, 0]
    said = plan._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,12)" in said
    assert "ids" not in token_files.metadata(spark, at)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    stream = [x for _, ids in sorted((r.start, r.ids) for r in token_files.tokens(spark, at).collect()) for x in ids]
    total = len(stream)
    for a, b in ((0, 10), (5, 400), (total - 7, total + 50), (total // 2, total // 2 + 1), (0, total), (total, total + 5), (9, 9)):
        cut = sorted((r.start, r.ids) for r in token_files.stream_range(spark, at, a, b).collect())
        assert [x for _, ids in cut for x in ids] == stream[a:b], (a, b)


def test_row_groups_are_controlled(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 300), i -> cast(xxhash64(id, i) as string)), ' ')").alias("text")).coalesce(1)
    at = str(tmp_path / "g")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1g")
    token_files.write_tokens(docs, BYTES, at, group_bytes=2 << 20, page_rows=100)
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(f"{at}/tokens/*.parquet")]
    assert sum(groups) >= 2 * len(groups) and token_files.metadata(spark, at).count() == 3000


def test_empty_table(spark, tmp_path):
    at = str(tmp_path / "e")
    token_files.write_tokens(spark.createDataFrame([], data.SCHEMA), BYTES, at)
    assert token_files.summaries(spark, at).count() == 0 == token_files.stream_range(spark, at, 0, 9).count()


def test_query(spark, library):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{queries_dir()}/documents.parquet").collect())
    got = sorted(map(tuple, queries.op13_token_files(spark, queries_dir()).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == expected(library, rows)


def queries_dir():
    from .test_queries import SF

    return SF
