"""From raw documents to token ids, in five stages.

Each stage gets what the one before kept, as a table that was written and read back, and its decisions take
effect.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loreworks.llm import bpe, decontaminate, neardup, quality, suffix_dedup
from loreworks.session import shared_dir, ship_package

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling takes; the others go."""
    ship_package(spark)
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    ship_package(spark)
    return neardup.keep_first(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes and more that occur earlier."""
    ship_package(spark)
    return suffix_dedup.remove_repeats(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, decontaminate.split_items(_table(spark, sf_dir, "benchmark")))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of texts."""
    ship_package(spark)
    return bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", select_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("bpe_encoding", encode_tokens),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
