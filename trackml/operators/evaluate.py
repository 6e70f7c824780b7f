"""Counts and metrics as DataFrame aggregations.

Each metric is one global aggregation with partial aggregation per partition,
so only one small row per task reaches the final reduce.  The results are
one-row DataFrames (rounded where a float is compared across engines).
"""

from __future__ import annotations

from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackml.functions.columns import hit
from trackml.operators.indexing import INDEXED_LABEL, PREDICTED_LABEL, PREDICTION
from trackml.operators.prepare import FEATURES, SUBSET
from trackml.sources.files import KEY, LABEL

METRIC_DECIMALS = 8


def subset_counts(df: DataFrame) -> DataFrame:
    """A1: rows per partition value in one pass (``subset, n_rows``)."""
    return df.groupBy(SUBSET).agg(F.count(F.lit(1)).alias("n_rows"))


def subset_label_counts(df: DataFrame) -> DataFrame:
    """Rows per (partition, label): how many tracks of each genre are in each subset."""
    return df.groupBy(SUBSET, LABEL).agg(F.count(F.lit(1)).alias("n_rows"))


def accuracy(predictions: DataFrame, label_col: str = INDEXED_LABEL,
             prediction_col: str = PREDICTION, decimals: int = METRIC_DECIMALS) -> DataFrame:
    """A4 + P7: ``n_rows, n_correct, accuracy, test_error`` (error = 1 - accuracy)."""
    agg = predictions.agg(F.count(F.lit(1)).alias("n_rows"),
                          F.sum(hit(label_col, prediction_col)).cast("bigint").alias("n_correct"))
    acc = F.try_divide("n_correct", "n_rows")
    return agg.select("n_rows", "n_correct",
                      F.round(acc, decimals).alias("accuracy"),
                      F.round(F.lit(1.0) - acc, decimals).alias("test_error"))


def per_class_accuracy(predictions: DataFrame, label_col: str = LABEL,
                       predicted_col: str = PREDICTED_LABEL,
                       decimals: int = METRIC_DECIMALS) -> DataFrame:
    """Accuracy per true class (recall): ``label, n_rows, n_correct, accuracy``."""
    hit = (F.col(predicted_col) == F.col(label_col)).cast("bigint")
    agg = predictions.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_rows"),
                                            F.sum(hit).alias("n_correct"))
    return agg.withColumn("accuracy", F.round(F.try_divide("n_correct", "n_rows"), decimals))


def evaluator_accuracy(predictions: DataFrame, label_col: str = INDEXED_LABEL,
                       prediction_col: str = PREDICTION) -> float:
    """A4 with Spark's own evaluator (what CrossValidator scores folds with)."""
    ev = MulticlassClassificationEvaluator(labelCol=label_col, predictionCol=prediction_col,
                                           metricName="accuracy")
    return ev.evaluate(predictions)


def regression_metrics(predictions: DataFrame, label_col: str = LABEL,
                       prediction_col: str = PREDICTION,
                       decimals: int = METRIC_DECIMALS) -> DataFrame:
    """A5 (and A6 on training rows): ``n_rows, rmse, r2`` in one pass.

    r2 = 1 - MSE / var_pop(y) over the same rows.  ``var_pop`` merges partial
    moments per partition (numerically stable, no second pass over the data).
    A constant label has no r2 (NULL); the RMSE stays.
    """
    y = F.col(label_col).cast("double")
    err = y - F.col(prediction_col)
    agg = predictions.agg(F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"),
                          F.var_pop(y).alias("var_y"))
    return agg.select(F.col("n").alias("n_rows"),
                      F.round(F.sqrt(F.col("mse")), decimals).alias("rmse"),
                      F.round(F.lit(1.0) - F.try_divide("mse", "var_y"), decimals).alias("r2"))


def evaluator_rmse(predictions: DataFrame, label_col: str = LABEL,
                   prediction_col: str = PREDICTION) -> float:
    """A5 with Spark's own evaluator."""
    return RegressionEvaluator(labelCol=label_col, predictionCol=prediction_col,
                               metricName="rmse").evaluate(predictions)


def sample_predictions(predictions: DataFrame, n: int = 5,
                       columns: tuple[str, ...] = (KEY, PREDICTED_LABEL, LABEL, FEATURES)
                       ) -> DataFrame:
    """The first ``n`` predictions by key with predicted label, label and
    features (a top-n report; the reference shows 5 rows of these columns)."""
    return predictions.select(*columns).orderBy(KEY).limit(n)
