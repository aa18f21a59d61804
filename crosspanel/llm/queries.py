"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, language, mixing, neighbours, quality_rules, secret_scan, sharding, spelling, substring_dedup, token_store, tokens, whitening
from .common import new_path, table


def op1_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op2_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op3_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(table(spark, sf_dir, "documents"))


def op4_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_int8_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), k=35)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op8_heavy_light_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), k=5)


def op9_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark)
    token_store.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out)
    return token_store.read_tokens(spark, out)


def op10_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), share=1.5, max_epochs=2.0)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(table(spark, sf_dir, "documents"))


def op13_tridiagonal_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


QUERIES = {
    f.__name__: f
    for f in (
        op1_weighted_hash_tree,
        op2_prefix_token_counts,
        op3_rank_order_language,
        op4_backtracking_bpe,
        op5_int8_block_neighbours,
        op6_fm_index_dedup,
        op7_line_first_quality,
        op8_heavy_light_jaccard,
        op9_simple8b_tokens,
        op10_capped_water_filling,
        op11_spelling_variants,
        op12_assignment_secrets,
        op13_tridiagonal_whitening,
    )
}
