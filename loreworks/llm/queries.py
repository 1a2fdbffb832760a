"""The registered queries of this subpackage: each operator over its whole table, and the pipeline."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from loreworks.llm import (
    block_search,
    bpe,
    cover_tree,
    decontaminate,
    grouped_join,
    neardup,
    pitman_yor,
    preferences,
    prefix_trie,
    quality,
    suffix_dedup,
    token_counts,
    token_files,
)
from loreworks.session import shared_dir, ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_block_matrix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return block_search.nearest(vectors.where("vec_id % 20 = 0"), vectors, 20)


def op2_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token_files/{uuid.uuid4().hex}"
    token_files.write_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return token_files.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(_table(spark, sf_dir, "documents"))


def op4_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = decontaminate.split_items(_table(spark, sf_dir, "benchmark"))
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), items)


def op5_digest_cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{shared_dir(spark)}/token_counts/{uuid.uuid4().hex}"
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


def op6_suffix_order_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(_table(spark, sf_dir, "documents"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_pairs(*preferences.replies_of_the_next(_table(spark, sf_dir, "conversations")))


def op9_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_join.linked_components(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(prefix_trie.numbered_turns(_table(spark, sf_dir, "conversations"))))


def op13_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cover_tree.noisy_labels(cover_tree.whole_vectors(_table(spark, sf_dir, "embeddings")))
    return cover_tree.hard_negatives(rows, rows.where("vec_id % 100 = 0"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = [
    op1_block_matrix_search,
    op2_repair_token_files,
    op3_pitman_yor_scores,
    op4_bm25_decontamination,
    op5_digest_cache_counts,
    op6_suffix_order_dedup,
    op7_importance_resampling,
    op8_preference_pairs,
    op9_trie_bpe,
    op10_prob_minhash,
    op11_grouped_prefix_join,
    op12_prefix_trie,
    op13_cover_tree_negatives,
    pipeline,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        return run

    return {fn.__name__: ready(fn) for fn in _QUERIES}


def twins() -> dict[str, str]:
    return {
        "op1_block_matrix_search": block_search.TWIN,
        "op8_preference_pairs": preferences.TWIN,
        "op11_grouped_prefix_join": grouped_join.TWIN,
        "op12_prefix_trie": prefix_trie.TWIN,
        "op13_cover_tree_negatives": cover_tree.TWIN,
    }
