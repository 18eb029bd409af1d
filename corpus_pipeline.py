"""Stages that turn `documents` into packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. `run` writes every result as Parquet below the
session's checkpoint folder and reads it again as the next stage's documents, so a lost executor costs no
more than the stage at hand.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from residua.llm import lines, minhash, packing, pii, toxicity
from residua.llm.registry import small_batches
from residua.operators.storage import drop_stored, scratch_directory, stored_tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Production keys come from the caller; this one only makes the run repeatable.
PII_KEY = "repeatable run"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; it learns from the labels of these documents."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdicts = toxicity.fit(docs, labels)
    return toxicity.with_scores(docs, verdicts).where("score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier equal or near line makes superfluous."""
    return lines.without_duplicate_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    small_batches(spark)
    return minhash.without_near_duplicates(docs, k=5).select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    small_batches(spark)
    return pii.replace_pii(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("packing", pack),
]

#: A trained classifier, keyed permutations and packing are beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_directory(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path, before = f"{folder}/{name}", stored_tables(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_stored(spark, keep=before)  # the stage's own tables
        docs = spark.read.parquet(path)
    return docs
