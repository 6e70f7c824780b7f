"""Optimality certificates of fitted linear models, each from small aggregates over the rows.

A certificate does not trust the optimiser: it recomputes from the rows what the
penalised objective's optimum must satisfy at the weights that were returned.

* Linear regression: everything follows from the sufficient statistics
  (counts, means, second moments of features and label), two small aggregates
  however many rows there are.
* Multinomial logistic regression: the mean of (probability - one-hot label)
  times feature, one aggregate of classes x features sums.

Spark ML penalises weights in the space of features (and, for regression, the
label) divided by their standard deviations; residuals are stated there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackml.operators.prepare import FEATURES
from trackml.sources.files import LABEL

#: largest residual (in standardised units) of weights that count as optimal
TOLERANCE = 1e-5


@dataclass(frozen=True)
class Moments:
    """Rows, means and sample covariance of the features and, last, the label."""

    n: int
    mean: np.ndarray
    cov: np.ndarray

    @property
    def std(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    def correlations(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the features with each other, and with the label; 0 for a constant one."""
        std = self.std
        scale = np.where(std > 0, std, 1.0)
        c = self.cov / np.outer(scale, scale)
        return c[:-1, :-1], c[:-1, -1]


def _mean_vector(df: DataFrame, values: Column) -> np.ndarray:
    return df.select(array_to_vector(values).alias("v")).agg(
        Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()


def moments(df: DataFrame, features: str = FEATURES, label: str = LABEL) -> Moments:
    """Two aggregates: the means, then the centred second moments (no cancellation)."""
    own = F.concat(vector_to_array(features), F.array(F.col(label).cast("double")))
    held = df.select(own.alias("x"))
    first = held.select(array_to_vector("x").alias("v")).agg(
        Summarizer.metrics("mean", "count").summary(F.col("v")).alias("s")).first()["s"]
    n, mean = first["count"], first["mean"].toArray()
    if n < 2:
        raise ValueError("moments need two rows or more")
    centred = F.zip_with("x", F.array(*(F.lit(float(m)) for m in mean)), lambda a, b: a - b)
    products = F.flatten(F.transform("c", lambda a: F.transform("c", lambda b: a * b)))
    second = _mean_vector(held.select(centred.alias("c")), products)
    return Moments(n, mean, second.reshape(len(mean), -1) * n / (n - 1))


def solve_ols(m: Moments) -> tuple[np.ndarray, float]:
    """Weights and intercept of least squares without penalty, from the moments."""
    c, r = m.correlations()
    std = m.std
    w = np.linalg.solve(c, r) * std[-1] / std[:-1]
    return w, float(m.mean[-1] - w @ m.mean[:-1])


def _residuals(weights: np.ndarray, gradient: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Distance of the gradient from what the penalty allows at each weight."""
    at_zero = np.maximum(np.abs(gradient) - l1, 0.0)
    off_zero = np.abs(gradient + l2 * weights + l1 * np.sign(weights))
    return np.where(weights == 0, at_zero, off_zero)


def _penalty(weights: np.ndarray, l1: float, l2: float) -> float:
    return float(l1 * np.abs(weights).sum() + 0.5 * l2 * (weights ** 2).sum())


@dataclass(frozen=True)
class Certificate:
    """Residual by weight (classes x features), of the intercepts, and the objective."""

    residuals: np.ndarray
    intercepts: np.ndarray
    objective: float

    def optimal(self, tolerance: float = TOLERANCE) -> bool:
        return bool(max(self.residuals.max(initial=0), self.intercepts.max(initial=0))
                    <= tolerance)


#: features up to which Spark's solver ``auto`` is ``normal``
NORMAL_FEATURES = 4096


def linear_certificate(m: Moments, coefficients: np.ndarray, intercept: float,
                       reg_param: float, elastic_net: float, population: bool) -> Certificate:
    """KKT residuals of elastic-net least squares, from the moments alone.

    ``population`` tells how Spark's solver scales features and label:
    ``normal`` divides by the number of rows, ``l-bfgs`` by one less.
    """
    share = (m.n - 1) / m.n
    std = m.std * (np.sqrt(share) if population else 1.0)
    scale = np.where(std > 0, std, 1.0)
    # the mean loss divides by n
    c = m.cov * share / np.outer(scale, scale)
    a, r, y = c[:-1, :-1], c[:-1, -1], c[-1, -1]
    coefficients = np.asarray(coefficients)
    w = coefficients * std[:-1] / scale[-1]
    l1, l2 = reg_param / scale[-1] * elastic_net, reg_param / scale[-1] * (1 - elastic_net)
    off = abs(m.mean[-1] - coefficients @ m.mean[:-1] - intercept) / scale[-1]
    loss = 0.5 * (y - 2 * r @ w + w @ a @ w + off ** 2)
    return Certificate(_residuals(w, a @ w - r, l1, l2)[None, :], np.array([off]),
                       float(loss + _penalty(w, l1, l2)))


def certify_linear(df: DataFrame, model: LinearRegressionModel, reg_param: float,
                   elastic_net: float, label: str = LABEL) -> Certificate:
    solver = model.getSolver()
    return linear_certificate(
        moments(df, model.getFeaturesCol(), label), model.coefficients.toArray(),
        model.intercept, reg_param, elastic_net, solver == "normal"
        or solver == "auto" and model.numFeatures <= NORMAL_FEATURES)


def logistic_certificate(df: DataFrame, coefficients: np.ndarray, intercepts: np.ndarray,
                         features: str, label: str, reg_param: float,
                         elastic_net: float) -> Certificate:
    """KKT residuals of multinomial logistic regression: two aggregates over the rows.

    ``label`` holds the class index.  Probabilities are computed here, from the
    weights given, so that any weights can be judged.
    """
    k, d = coefficients.shape
    held = df.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"))
    std = held.select(array_to_vector("x").alias("v")).agg(
        Summarizer.std(F.col("v")).alias("s")).first()["s"].toArray()
    scale = np.where(std > 0, std, 1.0)

    def dot(row: np.ndarray, bias: float) -> Column:
        weights = F.array(*(F.lit(float(w)) for w in row))
        return F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(float(bias)),
                           lambda acc, v: acc + v)

    margins = held.select("x", "y", F.array(*(
        dot(coefficients[i], intercepts[i]) for i in range(k))).alias("m"))
    margins = margins.select("x", "y", F.transform(
        "m", lambda v: v - F.array_max("m")).alias("m"))
    total = F.aggregate("m", F.lit(0.0), lambda acc, v: acc + F.exp(v))
    scored = margins.select("x", "y", "m", total.alias("z"))
    rest = F.transform("m", lambda v, i: F.exp(v) / F.col("z") - F.when(
        i == F.col("y"), 1.0).otherwise(0.0))
    loss = F.log("z") - F.get("m", F.col("y"))
    # one row of sums: the loss, the residual of each class, and residual times feature
    parts = F.concat(F.array(loss), F.col("r"), F.flatten(
        F.transform("r", lambda p: F.transform("x", lambda v: p * v))))
    sums = _mean_vector(scored.withColumn("r", rest), parts)
    gradient = sums[1 + k:].reshape(k, d) / scale
    weights = coefficients * scale
    l1, l2 = reg_param * elastic_net, reg_param * (1 - elastic_net)
    return Certificate(np.where(std > 0, _residuals(weights, gradient, l1, l2), 0.0),
                       np.abs(sums[1:1 + k]), float(sums[0] + _penalty(weights, l1, l2)))


def certify_logistic(df: DataFrame, model: LogisticRegressionModel, reg_param: float,
                     elastic_net: float) -> Certificate:
    """Certificate of a fitted multinomial model over the rows it was trained on."""
    matrix = model.coefficientMatrix.toArray()
    if matrix.shape[0] < 2:
        raise ValueError("a binomial model has one row of weights; fit family='multinomial'")
    return logistic_certificate(df, matrix, model.interceptVector.toArray(),
                                model.getFeaturesCol(), model.getLabelCol(), reg_param,
                                elastic_net)


def certificate_rows(spark: SparkSession, certificate: Certificate, labels: list[str],
                     names: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """``label, feature, optimal``: a row for each weight and intercept (model-sized)."""
    rows = []
    for i, label in enumerate(labels):
        rows += [(label, name, bool(x <= tolerance))
                 for name, x in zip(names, certificate.residuals[i], strict=True)]
        rows.append((label, "(intercept)", bool(certificate.intercepts[i] <= tolerance)))
    return spark.createDataFrame(rows, "label string, feature string, optimal boolean")


def history_agrees(history: list[float], objective: float, tolerance: float = 1e-6) -> bool:
    """The last value is the recomputed objective, and no value exceeds the one before."""
    falls = all(b <= a + tolerance for a, b in zip(history, history[1:]))
    return falls and abs(history[-1] - objective) <= tolerance * max(1.0, abs(objective))
