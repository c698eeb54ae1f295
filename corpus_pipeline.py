"""The corpus pipeline: each stage works on all that the one before it kept.

Every stage but the last returns the columns of documents: toxic documents go, documents that the
quality rules reject go, one document of each group of near copies stays, words of repeated passages
are taken out, and what is left is packed into sequences.

Defined cases: a null or empty text scores as an empty one and is rejected by the quality rules; very long
texts are read whole in every stage; of repeated rows one stays after near-dedup; a null source or
language is a group of its own; documents without an id are packed without one; an empty table gives
no pieces; columns other than those of documents are kept up to packing, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlens.llm import minhash, packing, quality, substring, toxicity
from riverlens.llm.common import cut
from riverlens.llm.queries import MIXTURE

#: SQL cannot express compression distances, minima or token ids; tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text where words were taken out."""
    out = substring.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As op3: a source's share of each window goes with its tokens to the power MIXTURE."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), temper=MIXTURE)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
