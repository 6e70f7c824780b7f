"""Corpus pipeline: stages over the documents table, each on what the last one kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackml.llm import minhash, packing, pii, quality_model, tiling
from trackml.llm.queries import tokenizer_path
from trackml.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more."""
    return quality_model.good_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest doc_id.

    Five-word shingles, similarity of 0.8 or more.  Of rows that share doc_id
    and text the one with the smallest other columns stays; rows of a kept
    doc_id with different texts all stay; rows without doc_id stay.
    """
    ids = minhash.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(
        F.max("kept").alias("_kept"), F.count("*").alias("_rows")).where("_kept")
    found = docs.join(ids, "doc_id")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = found.where("_rows > 1").groupBy("doc_id", "text").agg(
        F.min(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("_rest")).select(
        "doc_id", "text", *(F.col("_rest").getField(c).alias(c) for c in rest))
    return found.where("_rows = 1").select(*(F.col(f"`{c}`") for c in docs.columns)).union(
        again.select(*(F.col(f"`{c}`") for c in docs.columns))).union(
        docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return tiling.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return pii.pseudonymize(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in 1024-token sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express a trained classifier
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
