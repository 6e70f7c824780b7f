"""Certificates accept what Spark ML converged to, and nothing else."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

import __spark_entry__ as E
from trackml.operators import certify, models
from trackml.plans import catalog, jobs
from trackml.sources import fixtures

from conftest import SF_SMALL

PENALTIES = [(0.3, 0.8), (0.05, 0.5), (0.02, 1.0), (0.5, 0.0)]


@pytest.fixture(scope="module")
def year(spark):
    prepared, _ = jobs.prepare_year(fixtures.order_year_labels(spark, SF_SMALL),
                                    fixtures.order_features(spark, SF_SMALL))
    return prepared


@pytest.fixture(scope="module")
def logreg(spark):
    return catalog._converged_logreg(spark, SF_SMALL)


@pytest.mark.parametrize("name", ["logreg_certificate", "ols_year_all", "year_certificate",
                                  "objective_certificate"])
def test_twin_matches(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = E.queries()[name](spark, SF_SMALL)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({E.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("solver", ["normal", "l-bfgs"])
@pytest.mark.parametrize("penalty", PENALTIES)
def test_linear_solvers(year, solver, penalty):
    model = models.linear_regression(500, *penalty, solver=solver, tol=1e-13).fit(year)
    found = certify.certify_linear(year, model, *penalty)
    assert found.residuals.max() < 1e-7 and found.optimal()
    history = list(model.summary.objectiveHistory)
    if len(history) > 1:
        assert certify.history_agrees(history, found.objective)
    # the same weights are not the optimum of another penalty that leaves weights
    other = certify.certify_linear(year, model, penalty[0] / 10, penalty[1])
    assert not other.optimal()


def test_perturbed_linear_weight_fails(year):
    penalty = (0.02, 0.5)
    model = models.linear_regression(500, *penalty, tol=1e-13).fit(year)
    m = certify.moments(year)
    weights = model.coefficients.toArray()
    assert (weights != 0).any()
    for i in range(len(weights)):
        moved = weights.copy()
        moved[i] += 0.001 * m.std[-1] / m.std[i]
        assert not certify.linear_certificate(m, moved, model.intercept, *penalty, True).optimal()
    assert not certify.linear_certificate(m, weights, model.intercept + 0.01, *penalty,
                                          True).optimal()


def test_perturbed_logistic_weight_fails(logreg):
    run, model, train = logreg
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    args = (model.getFeaturesCol(), model.getLabelCol(), *catalog.LOGREG_PENALTY)
    found = certify.logistic_certificate(train, matrix, bias, *args)
    assert found.optimal() and (matrix != 0).any() and (matrix == 0).any()
    assert certify.history_agrees(list(model.summary.objectiveHistory), found.objective)
    for i, j in ((0, 0), (2, 3)):
        moved = matrix.copy()
        moved[i, j] += 0.02
        worse = certify.logistic_certificate(train, moved, bias, *args)
        assert not worse.optimal() and worse.objective > found.objective
    moved = bias.copy()
    moved[1] += 0.01
    assert not certify.logistic_certificate(train, matrix, moved, *args).optimal()
    # an unconverged fit is told apart as well
    early = models.logistic_regression(2, *catalog.LOGREG_PENALTY).fit(train)
    assert not certify.certify_logistic(train, early, *catalog.LOGREG_PENALTY).optimal()


def test_moments_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 1.0, (500, 3))
    x[:, 2] = 7.0
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(0, 0.1, 500)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)],
                               "a double, b double, c double, label double").repartition(4)
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    m = certify.moments(df)
    assert m.n == 500
    np.testing.assert_allclose(m.cov, np.cov(np.column_stack([x, y]).T), rtol=1e-6, atol=1e-6)
    # a constant feature has no correlation and takes no weight
    assert m.correlations()[0][2].tolist() == [0, 0, 0]


def test_ols_from_moments(year):
    model = models.linear_regression(reg_param=0.0, elastic_net=0.0).fit(year)
    weights, intercept = certify.solve_ols(certify.moments(year))
    np.testing.assert_allclose(weights, model.coefficients.toArray(), rtol=1e-6)
    assert abs(intercept - model.intercept) < 1e-6


def test_history_must_not_rise():
    assert certify.history_agrees([3.0, 2.0, 1.0], 1.0)
    assert not certify.history_agrees([3.0, 1.0, 2.0], 2.0)
    assert not certify.history_agrees([3.0, 2.0], 1.0)
