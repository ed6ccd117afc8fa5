"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, tokens."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import bpe, decontaminate, ngram_join, quality, substring_dedup
from quillgraph.llm.spark_util import release, shared_folder, table, trim_workers

#: SQL cannot express the classifier or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), 0.3)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 on five-word shingles one stays."""
    return ngram_join.keep_one_of_each(docs, 5, 80)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat an earlier document are cut."""
    return substring_dedup.remove_repeats(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in benchmark windows are cut."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"), 10)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document left."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ("ids",))


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", passage_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("byte_level_bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet in the shared folder and read again."""
    shared = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared}/{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark)
        trim_workers(spark)
    return docs
