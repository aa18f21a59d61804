"""The corpus pipeline: language ID, near duplicates, repeated passages, mixing, and tokens.

Each stage reads what its predecessor kept, as Parquet. All but the last return the columns of ``documents``.

All stages take null ids, texts and sources, repeated rows, empty tables and further columns of any names; an empty table
gives an empty one. Their docstrings say what becomes of nulls, ties and repeated rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.llm import jaccard_join, language, mixing, substring_dedup, tokens
from crosspanel.llm.common import materialize, small_batches, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null or without letters, or like no profile (``language.MIN_SCORE``).

    Profiles are learned from the documents given, outside the held-out fifth. If no row has a lang, all stay. Repeated rows
    stay or go together; of equal distances the first language counts, which decides nothing here.
    """
    small_batches(spark)
    profiles = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    return language.keep_identified(docs, profiles)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the one of the smallest id, null ids last.

    Rows equal in id and text are copies, with words or without; of those that differ elsewhere the one with the smallest hash
    of all columns stays. Texts without words are in no other group.
    """
    small_batches(spark)
    return jaccard_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 35 words or more that occur elsewhere too; n_chars follows the text.

    Null texts and those that lose nothing stay as they are; of repeated rows every passage goes. No row goes, even if its
    text becomes empty.
    """
    small_batches(spark)
    kept = substring_dedup.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it, 0 to 2 times.

    Null is a source of its own; null texts have size 0 and are taken like others. Repeated rows are drawn one by one, in an
    order among themselves that does not matter.
    """
    return mixing.repeat_documents(docs, share=1.5, max_epochs=2.0)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document of the mix, and the round trip's digests, one row for each row; null text counts as empty."""
    small_batches(spark)
    return tokens.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources),
    ("bpe", bpe),
]

#: The stages' n-gram profiles, similarity join and tokenizer are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
