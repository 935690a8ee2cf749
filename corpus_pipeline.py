"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes the documents that the one before it kept, decides over all of them, and returns the columns of
``documents`` (the last one: ids and digests of its encoding as well).  ``run`` writes each stage and reads it again.

Columns beyond those of ``documents`` pass through all stages but the last.  An empty table gives an empty result at every
stage.  What a stage does with nulls, ties, repeated rows and very long texts is said below; none cuts a text short.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import byte_bpe, common, decontaminate, language_id, line_dedup, near_dup


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that is recognised go: null and empty texts, those without a letter, and those whose best
    language has a posterior below 0.5.  Equal posteriors go to the label that sorts first.  Where no row has a label, none
    but texts without a letter go.  Rows that repeat are judged alike."""
    return language_id.keep_known(docs, public_tokenizers.path("piece_bpe_32k.model"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that an earlier document has are cut out; a document that consisted of them alone goes.  Earlier is the
    smaller id (null first), then the first line; rows that repeat wholly are one document and keep what is theirs, for the
    next stage to remove.  A null text stays null (the stage before lets none through)."""
    out = line_dedup.deduplicate(docs, counts=("__n_lines", "__n_removed"), windows=True)
    cut = F.col("__n_removed") > 0
    kept = out.where(~cut | (F.length(F.trim("text")) > 0))
    return kept.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: five-word shingles, similarity of 0.8 or more.  It is that of the smallest id (null
    last), then of the smallest digest; of rows that repeat wholly one stays.  Texts without words are in no group."""
    return near_dup.keep_one(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten words of the benchmark (or with a whole item of fewer words) go.  Null and empty texts
    have no window and stay; rows that repeat are judged alike; an empty benchmark removes none."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document and the digest of what they decode to; a null text counts as empty.  One row for each row."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source", "n_chars"), with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
