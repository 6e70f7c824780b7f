"""The driver's Parquet tables seen as track inputs.

Track = order.  ``features`` is an aggregation of ``lineitem`` per order (it
only makes a test input; it is not one of the reference's operators),
``labels`` is the order priority, ``splits`` a key-derived 80/20 partition and
``year_labels`` the order year.  ``embeddings`` gives a second, wider input
(64 floats in one array column, 10 classes).

All readers are lazy DataFrames over ``spark.read.parquet``: filters and
column selections downstream reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackml.sources.files import KEY, LABEL, SUBSET, YEAR

# Fixed values of the fixture mapping: split rule (key mod 10 below 8 → TRAIN).
TRAIN = "TRAIN"
TEST = "TEST"
SPLIT_MODULUS = 10
SPLIT_TRAIN_BELOW = 8

ORDER_FEATURES = ["n_items", "qty", "cents", "n_rf", "n_ls"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _key_split(key: F.Column) -> F.Column:
    return (F.when(F.pmod(key, F.lit(SPLIT_MODULUS)) < SPLIT_TRAIN_BELOW, F.lit(TRAIN))
            .otherwise(F.lit(TEST)))


def _distinct_capitals(column: str) -> F.Column:
    """Distinct values of a column of single capital letters; others fail."""
    flag = F.col(column)
    letter = F.when(flag.rlike("^[A-Z]$"), F.ascii(flag) - 65).when(
        flag.isNotNull(), F.raise_error(F.lit(f"{column} is not one capital letter")))
    bit = F.call_function("shiftleft", F.lit(1), letter)
    return F.bit_count(F.coalesce(F.bit_or(bit), F.lit(0)))


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: five DOUBLE features in a fixed order.

    One aggregation keyed by order with a single shuffle; partial aggregation
    runs before it, so a hot order key is combined map-side.  The two distinct
    counts are taken as bits set in a per-order mask of flag letters: unlike
    ``count(DISTINCT)``, which expands every row once per distinct column and
    needs a second shuffle, this keeps one pass and a generated hash aggregate.
    """
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_orderkey").alias(KEY))
            .agg(F.count(F.lit(1)).cast("double").alias("n_items"),
                 F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("qty"),
                 F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
                 .cast("double").alias("cents"),
                 _distinct_capitals("l_returnflag").cast("double").alias("n_rf"),
                 _distinct_capitals("l_linestatus").cast("double").alias("n_ls")))


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias(KEY), F.col("o_orderpriority").alias(LABEL))


def order_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias(KEY), _key_split(F.col("o_orderkey")).alias(SUBSET))


def order_year_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias(KEY), F.year("o_orderdate").alias(YEAR))


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias(KEY), F.col("embedding").alias("embedding"))


def embedding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias(KEY), F.col("label").cast("string").alias(LABEL))


def embedding_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias(KEY), _key_split(F.col("vec_id")).alias(SUBSET))


# name → (features, labels, splits) builders; the experiment manifest refers
# to feature/label/split sets by these names.
FEATURE_SETS = {"orders": order_features, "embeddings": embedding_features}
LABEL_SETS = {"orders": order_labels, "embeddings": embedding_labels,
              "orders_year": order_year_labels}
SPLIT_SETS = {"orders": order_splits, "embeddings": embedding_splits}


def order_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"features": order_features(spark, sf_dir),
            "labels": order_labels(spark, sf_dir),
            "splits": order_splits(spark, sf_dir)}


def embedding_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"features": embedding_features(spark, sf_dir),
            "labels": embedding_labels(spark, sf_dir),
            "splits": embedding_splits(spark, sf_dir)}
