"""The corpus pipeline: stages over `documents`, each written as Parquet and reread.

Null texts, empty texts and texts without a letter go in the first stage. The last stage returns
doc_id, n_tokens, and the digests of the ids and of the bytes they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaintrail.llm import byte_bpe, decontaminate, language_id, minhash_dedup, pii
from chaintrail.llm.registry import query, table
from chaintrail.session import discard, materialise


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected, by a model of the labelled rows of `docs`."""
    return language_id.keep_recognised(docs, language_id.learned(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5 words, 0.8): that with the smallest doc_id.

    Every row is a document of its own, also where a doc_id is missing or stands for several texts;
    rows without doc_id stay only where no row of their group has one. Texts without words stay.
    """
    row = "_near_duplicate_row"
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(row).alias("doc_id"), "text")
    groups = minhash_dedup.near_duplicates(texts, k=5, num=80, den=100).select(F.col("doc_id").alias(row), "component_id")
    named = groups.join(numbered.select(row, "doc_id"), row)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row")))
    kept = named.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data masked and n_chars of a changed text."""
    return pii.mask(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language_id", language_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", personal_data_stage),
    ("byte_bpe", token_stage),
]

#: Trained and latent models have no SQL; each stage is tested on small tables instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # the written table of the stage before
    return docs


query("pipeline", ORACLE_SQL)(run)
