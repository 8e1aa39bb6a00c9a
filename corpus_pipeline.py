"""The corpus pipeline: five operators of ``cohortwise.llm`` applied in turn to the documents.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of ``documents``; the last returns token ids. Extra columns are carried along. Rows that share
a doc_id stay or go together in the near-duplicate stage; rows without doc_id have no near
duplicates. Null texts count as empty and are kept by every filter.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm import bpe, decontamination, near_dedup, queries, secret_scan, toxicity
from cohortwise.llm.textwork import bound_batches, settle


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    bound_batches(spark)
    model = queries.toxicity_model(docs, spark, sf_dir)
    return docs.where(toxicity.score_column(model) < 0.5)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest doc_id, of each group of near duplicates."""
    gone = near_dedup.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    gone = settle(gone, "gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    bound_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for holds in decontamination.contaminated_columns(docs, items):
        docs = docs.where(~holds)
    return docs


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by their kind."""
    bound_batches(spark)
    cleaned = docs.withColumn("text", secret_scan.redact_column())
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, little-endian unsigned 32-bit) and a digest of the text that they decode to."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("bpe", bpe_stage),
]

#: A trained classifier is not SQL: tests hold the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage returns is settled before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
