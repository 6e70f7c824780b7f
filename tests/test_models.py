"""Models, pipelines, metrics (F5, M1-M7, A4-A6) — ML invariants of SURVEY §5."""

import pytest
from pyspark.sql import functions as F

from trackml.operators import evaluate, models
from trackml.plans import jobs
from trackml.sources import fixtures

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def logreg_run(spark):
    return jobs.run_genre_logreg(fixtures.order_inputs(spark, SF_SMALL))


def test_logreg_defaults_collapse_to_majority(logreg_run):
    lr = models.estimator_stage(logreg_run.model)
    assert (abs(lr.coefficientMatrix.toArray()) > 0).sum() == 0
    preds = {r.predictedLabel for r in logreg_run.predictions.select("predictedLabel").collect()}
    assert preds == {"2-HIGH"}
    acc = logreg_run.accuracy().first()
    assert (acc.n_train, acc.n_test) == (1181, 292)
    assert round(acc.accuracy, 6) == 0.184932


def test_transform_preserves_rows(logreg_run):
    assert logreg_run.predictions.count() == logreg_run.test.count()


def test_accuracy_equals_evaluator(logreg_run):
    ours = logreg_run.accuracy().first().accuracy
    theirs = evaluate.evaluator_accuracy(logreg_run.predictions)
    assert abs(ours - theirs) < 1e-8


def test_coefficient_rows(spark, logreg_run):
    lr = models.estimator_stage(logreg_run.model)
    rows = models.coefficient_rows(spark, lr, logreg_run.label_model.labels,
                                   logreg_run.feature_names)
    assert rows.count() == 5 * (5 + 1)
    assert {r.feature for r in rows.collect()} == set(fixtures.ORDER_FEATURES) | {"(intercept)"}


def test_forest_same_seed_same_predictions(spark):
    inp = fixtures.order_inputs(spark, SF_SMALL)
    a = jobs.run_genre_forest(inp, 5, max_depth=3, seed=11).predictions
    b = jobs.run_genre_forest(inp, 5, max_depth=3, seed=11).predictions
    pa = sorted((r.track_id, r.prediction) for r in a.select("track_id", "prediction").collect())
    pb = sorted((r.track_id, r.prediction) for r in b.select("track_id", "prediction").collect())
    assert pa == pb


def test_forest_validation(spark):
    with pytest.raises(ValueError):
        models.random_forest(10, impurity="variance")
    with pytest.raises(ValueError):
        models.random_forest(None)
    with pytest.raises(ValueError):
        models.random_forest(10, feature_subset_strategy="most")


def test_year_metrics_agree_with_summary(spark):
    run = jobs.run_year(fixtures.order_year_labels(spark, SF_SMALL),
                        fixtures.order_features(spark, SF_SMALL), reg_param=0.0,
                        elastic_net=0.0, split="key", feature_cols=["qty"])
    train_scored = run.model.transform(run.train)
    ours = evaluate.regression_metrics(train_scored).first()
    s = run.model.summary
    assert abs(ours.rmse - s.rootMeanSquaredError) < 1e-6
    assert abs(ours.r2 - s.r2) < 1e-6
    test_rmse = evaluate.regression_metrics(run.predictions).first().rmse
    assert abs(test_rmse - evaluate.evaluator_rmse(run.predictions)) < 1e-6
    hist = models.objective_history_rows(spark, run.model)
    assert hist.count() >= 1


def test_year_default_random_split(spark):
    run = jobs.run_year(fixtures.order_year_labels(spark, SF_SMALL),
                        fixtures.order_features(spark, SF_SMALL))
    n = run.train.count() + run.test.count()
    assert n == run.prepared.count()
    coefs = models.linear_coefficient_rows(spark, run.model, run.feature_names)
    assert coefs.count() == len(fixtures.ORDER_FEATURES) + 1


def test_index_on_train_only(spark):
    run = jobs.run_genre_logreg(fixtures.order_inputs(spark, SF_SMALL), index_on="train")
    assert run.predictions.count() == 292


def test_aggregation_depth_is_a_fixed_parameter(spark):
    assert models.logistic_regression().getAggregationDepth() == models.AGGREGATION_DEPTH
    assert models.linear_regression(aggregation_depth=4).getAggregationDepth() == 4


def test_constant_label_has_no_r2(spark):
    df = spark.createDataFrame([(3.0, 2.0), (3.0, 4.0)], "label double, prediction double")
    [row] = evaluate.regression_metrics(df).collect()
    assert (row.rmse, row.r2) == (1.0, None)
    [row] = evaluate.accuracy(df.limit(0), "label", "prediction").collect()
    assert row.accuracy is None


def test_release_staged_input(spark):
    run = jobs.run_genre_logreg(fixtures.order_inputs(spark, SF_SMALL))
    acc = run.accuracy().first().accuracy
    roots = run.release()
    assert len(roots) == 1 and "/trackml/genre-" in roots[0]
    assert spark.read.parquet(roots[0]).count() == 0
    assert round(acc, 6) == 0.184932


def test_year_hash_split(spark):
    run = jobs.run_year(fixtures.order_year_labels(spark, SF_SMALL),
                        fixtures.order_features(spark, SF_SMALL), split="hash")
    n_train, n_test = run.train.count(), run.test.count()
    assert n_train + n_test == run.prepared.count()
    assert 0.6 < n_train / (n_train + n_test) < 0.8
