"""Grid search with k-fold cross-validation.

Folds come from the key (``assign_folds``) and reach ``CrossValidator`` through
``foldCol``: no random column, no sort, and a fold filter on a staged Parquet
table is pushed to the scan.  ``parallelism`` trains that many grid points of a
fold at the same time (driver threads submitting distributed jobs).
"""

from __future__ import annotations


from pyspark.ml import Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackml.operators.indexing import INDEXED_LABEL, PREDICTION
from trackml.operators.models import DEFAULT_SEED, check_impurity, check_subset_strategy
from trackml.operators.prepare import FOLD

DEFAULT_FOLDS = 10
LOGREG_GRID_PARAMS = ("maxIter", "regParam", "elasticNetParam")
FOREST_GRID_PARAMS = ("numTrees", "maxBins", "maxDepth", "impurity", "featureSubsetStrategy")


def _require(values, name):
    values = list(values or [])
    if not values:
        raise ValueError(f"grid list {name!r} is required and may not be empty")
    return values


def logreg_grid(estimator, max_iter, reg_param, elastic_net) -> list[dict]:
    """G1: maxIter x regParam x elasticNetParam, in that nesting order."""
    return (ParamGridBuilder()
            .addGrid(estimator.maxIter, [int(v) for v in _require(max_iter, "maxIter")])
            .addGrid(estimator.regParam, [float(v) for v in _require(reg_param, "regParam")])
            .addGrid(estimator.elasticNetParam,
                     [float(v) for v in _require(elastic_net, "elasticNetParam")])
            .build())


def forest_grid(estimator, num_trees, max_bins, max_depth, impurity,
                feature_subset_strategy) -> list[dict]:
    """numTrees x maxBins x maxDepth x impurity x featureSubsetStrategy.

    Impurities and strategies are checked here, before any training starts.
    """
    impurities = [check_impurity(v) for v in _require(impurity, "impurity")]
    strategies = [check_subset_strategy(v)
                  for v in _require(feature_subset_strategy, "featureSubsetStrategy")]
    return (ParamGridBuilder()
            .addGrid(estimator.numTrees, [int(v) for v in _require(num_trees, "numTrees")])
            .addGrid(estimator.maxBins, [int(v) for v in _require(max_bins, "maxBins")])
            .addGrid(estimator.maxDepth, [int(v) for v in _require(max_depth, "maxDepth")])
            .addGrid(estimator.impurity, impurities)
            .addGrid(estimator.featureSubsetStrategy, strategies)
            .build())


def accuracy_evaluator() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol=INDEXED_LABEL, predictionCol=PREDICTION,
                                             metricName="accuracy")


# Grid points trained at the same time per fold.  Each holds its own cached
# copy of the fold's training rows, so more of them need more executor disk.
PARALLEL_FITS = 2


def cross_validate(pipeline: Pipeline, grid: list[dict], train: DataFrame, num_folds: int,
                   parallelism: int = PARALLEL_FITS, seed: int = DEFAULT_SEED,
                   fold_col: str | None = FOLD) -> CrossValidatorModel:
    """K-fold CV scored by accuracy; the best point is refitted on all of ``train``.

    With ``fold_col`` (default) the folds are the key-derived ones already in
    ``train``; with ``None`` Spark assigns random folds from ``seed``.
    ``parallelism`` grid points are trained at the same time.
    """
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=grid,
                        evaluator=accuracy_evaluator(), numFolds=num_folds,
                        parallelism=parallelism, seed=seed)
    if fold_col:
        cv = cv.setFoldCol(fold_col)
    return cv.fit(train)


def _param_value(value):
    return value if isinstance(value, str) else float(value)


def grid_results(spark: SparkSession, model: CrossValidatorModel,
                 param_names: tuple[str, ...]) -> DataFrame:
    """G4 + A7: ``grid_id, <params>, avg_metric, std_metric`` in grid order.

    Parameters are typed by name: strings stay strings, numbers are DOUBLE.
    """
    maps = model.getEstimatorParamMaps()
    avgs = list(model.avgMetrics)
    stds = list(getattr(model, "stdMetrics", None) or [float("nan")] * len(avgs))
    rows = []
    kinds = {}
    for i, pm in enumerate(maps):
        by_name = {p.name: v for p, v in pm.items()}
        values = []
        for name in param_names:
            v = by_name.get(name)
            kinds[name] = T.StringType() if isinstance(v, str) else T.DoubleType()
            values.append(None if v is None else _param_value(v))
        rows.append((i, *values, float(avgs[i]), float(stds[i])))
    schema = T.StructType([T.StructField("grid_id", T.IntegerType())]
                          + [T.StructField(n, kinds.get(n, T.DoubleType())) for n in param_names]
                          + [T.StructField("avg_metric", T.DoubleType()),
                             T.StructField("std_metric", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


def best_params(results: DataFrame) -> DataFrame:
    """The grid point with the highest average metric; the first such
    point in grid order wins ties (as ``maxBy`` does)."""
    return results.orderBy(F.col("avg_metric").desc(), F.col("grid_id").asc()).limit(1)
