"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, counts, embedding, html, langid, lexical, minhash, packing, periodic, quality, substring, toxicity

#: Power of a source's tokens that its share of each packed window goes with.
MIXTURE = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal(_table(spark, sf_dir, "documents"))


def op2_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_table(spark, sf_dir, "conversations"))


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target mixture: a source's share of each window goes with its tokens to the power MIXTURE."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), temper=MIXTURE)


def op7_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.looped(_table(spark, sf_dir, "documents")))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.over_limit(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_chat_snapshots": op2_chat_snapshots,
    "op3_mixture_packing": op3_mixture_packing,
    "op4_adaptive_quality": op4_adaptive_quality,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_html_wrappers": op7_html_wrappers,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_lexical_search": op11_lexical_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_counts": op13_token_counts,
}
ORACLE_SQL: dict[str, str] = {"op2_chat_snapshots": chat.ORACLE_SQL, "op4_adaptive_quality": quality.ORACLE_SQL, "op11_lexical_search": lexical.ORACLE_SQL}
