"""Estimators, pipelines and model reports.

Training is Spark ML's: gradients and tree statistics are combined with
``treeAggregate`` across executors, so the driver only sees one aggregate per
iteration / tree level.  ``aggregation_depth`` raises the tree depth of that
combine for very many partitions.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel, VectorIndexerModel
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from trackml.operators.indexing import INDEXED_FEATURES, INDEXED_LABEL, label_decoder
from trackml.operators.prepare import FEATURES
from trackml.sources.files import LABEL

CLASSIFIER_IMPURITIES = ("gini", "entropy")
SUBSET_STRATEGIES = ("auto", "all", "onethird", "sqrt", "log2")

# One seed for every random step; PySpark's default seed depends on the
# process's string hashing, so it is always passed explicitly.
DEFAULT_SEED = 42

# Levels of treeAggregate in linear models; never chosen from the data's size.
AGGREGATION_DEPTH = 2


def logistic_regression(max_iter: int = 10, reg_param: float = 0.3,
                        elastic_net: float = 0.8,
                        aggregation_depth: int = AGGREGATION_DEPTH,
                        tol: float | None = None) -> LogisticRegression:
    """M1: logistic regression on the indexed columns.

    Family is Spark's default ``auto`` (as in the reference): multinomial for
    more than two classes, binomial for two.  ``aggregation_depth`` is the
    depth of the gradient sums' ``treeAggregate`` (raise it on clusters with
    very many partitions; it changes the order of sums, so it is fixed).
    """
    lr = LogisticRegression(featuresCol=INDEXED_FEATURES, labelCol=INDEXED_LABEL,
                            maxIter=max_iter, regParam=reg_param, elasticNetParam=elastic_net)
    lr.setAggregationDepth(aggregation_depth)
    return lr if tol is None else lr.setTol(tol)


def check_impurity(impurity: str) -> str:
    if impurity not in CLASSIFIER_IMPURITIES:
        raise ValueError(f"impurity {impurity!r} is not valid for a classifier; "
                         f"use one of {CLASSIFIER_IMPURITIES}")
    return impurity


def check_subset_strategy(strategy: str) -> str:
    if strategy in SUBSET_STRATEGIES:
        return strategy
    try:
        value = float(strategy)
    except ValueError:
        raise ValueError(f"featureSubsetStrategy {strategy!r} is not valid") from None
    if value <= 0:
        raise ValueError(f"featureSubsetStrategy {strategy!r} must be positive")
    return strategy


def random_forest(num_trees: int, max_depth: int = 5, feature_subset_strategy: str = "auto",
                  impurity: str = "gini", max_bins: int = 32, seed: int = DEFAULT_SEED,
                  checkpoint_interval: int = 10, bootstrap: bool = True
                  ) -> RandomForestClassifier:
    """M2: random-forest classifier; ``num_trees`` has no default, as in the reference.

    Node ids are cached per row (``cacheNodeIds``) and checkpointed every
    ``checkpoint_interval`` levels into the session's checkpoint folder, which
    keeps the lineage of deep trees short.
    """
    if num_trees is None or num_trees < 1:
        raise ValueError("num_trees is required and must be positive")
    strategy = check_subset_strategy(feature_subset_strategy)
    return RandomForestClassifier(featuresCol=INDEXED_FEATURES, labelCol=INDEXED_LABEL,
                                  numTrees=num_trees, maxDepth=max_depth,
                                  featureSubsetStrategy=strategy,
                                  impurity=check_impurity(impurity), maxBins=max_bins,
                                  seed=seed, cacheNodeIds=True, bootstrap=bootstrap,
                                  checkpointInterval=checkpoint_interval)


def linear_regression(max_iter: int = 10, reg_param: float = 0.3, elastic_net: float = 0.8,
                      solver: str = "auto", label_col: str = LABEL,
                      aggregation_depth: int = AGGREGATION_DEPTH,
                      tol: float | None = None) -> LinearRegression:
    """M3: elastic-net linear regression on the raw feature vector."""
    lr = LinearRegression(featuresCol=FEATURES, labelCol=label_col, maxIter=max_iter,
                          regParam=reg_param, elasticNetParam=elastic_net, solver=solver)
    lr.setAggregationDepth(aggregation_depth)
    return lr if tol is None else lr.setTol(tol)


def classification_pipeline(label_model: StringIndexerModel, feature_model: VectorIndexerModel,
                            estimator) -> Pipeline:
    """pre-fitted indexers, the estimator, then the label decoder.

    The indexers are already models, so fitting the pipeline (also once per
    fold and grid point) trains only the estimator.
    """
    return Pipeline(stages=[label_model, feature_model, estimator, label_decoder(label_model)])


def index_stages(label_model: StringIndexerModel, feature_model: VectorIndexerModel
                 ) -> PipelineModel:
    """The two fitted indexers as one transformer (applied before tuning)."""
    return PipelineModel(stages=[label_model, feature_model])


def estimator_stage(model: PipelineModel):
    """The fitted estimator inside a classification pipeline (third stage)."""
    return model.stages[2]


def _names(count: int, names: list[str] | None) -> list[str]:
    if names and len(names) == count:
        return list(names)
    return [f"f{i}" for i in range(count)]


def coefficient_rows(spark: SparkSession, model: LogisticRegressionModel, labels: list[str],
                     feature_names: list[str] | None = None) -> DataFrame:
    """M4: ``label, feature, weight`` rows of the coefficient matrix, plus one
    ``(intercept)`` row per class.  Size is classes x features (the model).
    A binomial model has one row, for the positive class (index 1)."""
    matrix = model.coefficientMatrix.toArray()
    intercepts = model.interceptVector.toArray()
    names = _names(matrix.shape[1], feature_names)
    offset = 1 if matrix.shape[0] == 1 and len(labels) == 2 else 0
    rows = []
    for k in range(matrix.shape[0]):
        label = labels[k + offset] if k + offset < len(labels) else str(k + offset)
        rows.extend((label, names[j], float(matrix[k, j])) for j in range(matrix.shape[1]))
        rows.append((label, "(intercept)", float(intercepts[k])))
    schema = T.StructType([T.StructField("label", T.StringType()),
                           T.StructField("feature", T.StringType()),
                           T.StructField("weight", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


def linear_coefficient_rows(spark: SparkSession, model: LinearRegressionModel,
                            feature_names: list[str] | None = None) -> DataFrame:
    """M5: ``feature, weight`` rows plus the intercept."""
    coefs = model.coefficients.toArray()
    names = _names(len(coefs), feature_names)
    rows = [(names[j], float(coefs[j])) for j in range(len(coefs))]
    rows.append(("(intercept)", float(model.intercept)))
    schema = T.StructType([T.StructField("feature", T.StringType()),
                           T.StructField("weight", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


def objective_history_rows(spark: SparkSession, model) -> DataFrame:
    """M6: ``iteration, objective`` from a training summary, plus total iterations."""
    summary = model.summary
    history = list(summary.objectiveHistory)
    total = int(summary.totalIterations)
    schema = T.StructType([T.StructField("iteration", T.IntegerType()),
                           T.StructField("objective", T.DoubleType()),
                           T.StructField("total_iterations", T.IntegerType())])
    return spark.createDataFrame([(i, float(v), total) for i, v in enumerate(history)], schema)

