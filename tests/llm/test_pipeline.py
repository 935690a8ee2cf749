from __future__ import annotations

import corpus_pipeline
from loomspark.llm import byte_bpe, common

from . import data
from .test_near_dup import brute


def test_stages(spark, tmp_path):
    data.table(spark, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(data.texts()[14].split()[:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, str(tmp_path)), name)
        assert 0 < docs.count() <= n
        n = docs.count()
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "near_dedup":
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            assert {r.doc_id for r in docs.collect()} == {i for i, _, _, k in brute(rows, 5) if k}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.ids_sha256 for r in whole.collect()) == sorted(r.ids_sha256 for r in docs.collect())


def test_keeps_clean_documents(spark):
    at = "/root/testdata/sf0.001"
    made = corpus_pipeline.run(spark, at)
    total = spark.read.parquet(f"{at}/documents.parquet").count()
    assert made.count() > total // 2
    assert byte_bpe.ranks_of(__import__("public_tokenizers").path("byte_bpe_50k.tiktoken"))


def test_empty_table(spark, tmp_path):
    data.table(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some words of an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_repeat(spark, tmp_path):
    """Whole repeats and groups of null ids leave one row each, through all stages."""
    base = data.texts()[14]
    rows = [(1, base, "en", "s", 1), (1, base, "en", "s", 1), (None, base + " one more", "en", "s", 1), (None, base + " one more", "en", "s", 1), (2, "other words of another text " + data.texts()[20], "de", "s", 1)]
    spark.createDataFrame(rows, data.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nowhere to be found at all in any of these texts here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
