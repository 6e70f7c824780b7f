"""Registered queries over the driver's tables, and their DuckDB twins.

Every query takes ``(spark, sf_dir)``, reads whole tables and returns a
DataFrame.  Float outputs that are compared across engines are rounded
(metrics to 8 decimals, regression intercept / RMSE to 6).

Twins marked SQL* hold for the stated configuration only: with strong elastic
net regularisation the logistic models keep all coefficients at zero on these
fixtures, so every row is predicted as the most frequent training class (ties:
lowest label index).  The tests check the zero coefficients directly.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.ml.feature import IndexToString
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackml.functions.columns import rounded
from trackml.operators import certify, evaluate, indexing, models, prepare, tuning
from trackml.plans import experiments, jobs
from trackml.session import checkpoint_root, release, stage_path
from trackml.sources import files, fixtures
from trackml.sources.files import KEY, LABEL, SUBSET

# Configurations used by the registered queries (fixed values).
CV_FOLDS = 3
LOGREG_CV_GRID = {"max_iter": [10], "reg_param": [0.3, 0.1], "elastic_net": [0.2, 0.8]}
FOREST_TREES = 10
FOREST_CV_GRID = {"num_trees": [5, 10], "max_depth": [4], "max_bins": [16],
                  "impurity": ["gini"], "feature_subset_strategy": ["auto"]}
YEAR_TRAIN_FRACTION = 0.7
OLS_FEATURE = "qty"
# (regParam, elasticNetParam): the reference's, and lighter ones that leave weights
YEAR_PENALTY = (0.3, 0.8)
YEAR_LIGHT_PENALTY = (0.01, 0.5)
LOGREG_PENALTY = (0.001, 0.5)
CONVERGED_ITERATIONS, CONVERGED_TOL = 500, 1e-12


# ---------------------------------------------------------------- helpers

def _orders(spark, sf_dir):
    return fixtures.order_inputs(spark, sf_dir)


def _joined(spark, sf_dir) -> DataFrame:
    i = _orders(spark, sf_dir)
    return prepare.join_tracks(i["splits"], i["labels"], i["features"])


def _logreg_run(spark, sf_dir, inputs=None):
    return jobs.run_genre_logreg(inputs or _orders(spark, sf_dir))


def _slots(n: int) -> list[str]:
    return [f"slot{i}" for i in range(n)]


# ---------------------------------------------------------------- relational steps

def track_join(spark, sf_dir):
    """J1."""
    return _joined(spark, sf_dir)


def year_join(spark, sf_dir):
    """J2."""
    return prepare.join_year(fixtures.order_year_labels(spark, sf_dir),
                             fixtures.order_features(spark, sf_dir))


def subset_counts(spark, sf_dir):
    """A1."""
    return evaluate.subset_counts(_joined(spark, sf_dir))


def subset_label_counts(spark, sf_dir):
    """Minimum slice: tracks per (subset, genre)."""
    return evaluate.subset_label_counts(_joined(spark, sf_dir))


def train_rows(spark, sf_dir):
    """P6 / R1."""
    return prepare.subset_rows(_joined(spark, sf_dir), prepare.TRAIN)


def test_rows(spark, sf_dir):
    """P6 / R1."""
    return prepare.subset_rows(_joined(spark, sf_dir), prepare.TEST)


def text_inputs_join(spark, sf_dir):
    """S1-S4, P1 + J1: the three inputs written as CSV / TSV, read back with the
    delimited-file readers (string keys), then joined."""
    i = _orders(spark, sf_dir)
    base = f"{checkpoint_root(spark).rstrip('/')}/trackml/text-{uuid.uuid4().hex}"
    feats = i["features"].withColumnRenamed(KEY, files.SOURCE_KEY)
    feats.write.option("header", True).csv(f"{base}/features")
    i["labels"].write.option("sep", "\t").csv(f"{base}/labels")
    # partition files carry '%' comment lines; the reader must skip them (S3)
    comment = spark.createDataFrame([("% subset per track, written by trackml", None)],
                                    "track_id string, subset string")
    splits = i["splits"].select(F.col(KEY).cast("string").alias(KEY), SUBSET)
    splits.unionByName(comment).write.option("sep", "\t").csv(f"{base}/splits")
    read = files.read_track_inputs(spark, f"{base}/features", f"{base}/labels", f"{base}/splits")
    return prepare.join_tracks(read["splits"], read["labels"], read["features"])


# Lines spoilt by the key's remainder: a field missing, one too many, a value
# that is no number (fixed values of the query and its twin).
SPOILT = {1: "short", 2: "long", 3: "value"}
SPOILT_MODULUS = 50


def _spoilt_lines(df: DataFrame, cells: list[str], sep: str, number: int | None) -> DataFrame:
    """``line`` of each row; ``number`` is the place of a numeric cell that can be spoilt."""
    rest = F.pmod(F.col(KEY), F.lit(SPOILT_MODULUS))
    own = [F.col(c).cast("string") for c in cells]
    line = F.concat_ws(sep, *own)
    wrong = list(own)
    if number is not None:
        wrong[number] = F.lit("n/a")
    return df.select(F.when(rest == 1, F.concat_ws(sep, *own[:-1]))
                     .when(rest == 2, F.concat(line, F.lit(f"{sep}more")))
                     .when(rest == 3, F.concat_ws(sep, *wrong)).otherwise(line).alias("line"))


def _write_lines(lines: DataFrame, path: str, header: str | None) -> None:
    if header is None:
        lines.write.text(path)
    else:  # one raw column under the header line, unquoted
        lines.withColumnRenamed("line", header).write.option("header", True) \
            .option("sep", "\u0001").option("quote", "\u0000").csv(path)


def quarantined_rows(spark, sf_dir):
    """The four inputs written from the orders with spoilt lines, each read
    back by one parse; rows and keys kept, and quarantined by reason."""
    base = stage_path(spark, "spoilt")
    orders = fixtures.order_labels(spark, sf_dir).join(
        fixtures.order_splits(spark, sf_dir), KEY).join(
        fixtures.order_year_labels(spark, sf_dir), KEY).withColumn(
        "artist", F.lit('"a, b"')).withColumn("half", F.col(KEY) / 2)
    inputs = {
        "features": ([KEY, files.YEAR, "half"], ",", 1, f"{files.SOURCE_KEY},x,y",
                     files.parse_features_csv),
        "labels": ([KEY, LABEL], "\t", None, None, files.parse_labels_tsv),
        "splits": ([KEY, SUBSET], "\t", None, None, files.parse_splits_tsv),
        "years": ([KEY, files.YEAR, "artist"], ",", 1, f"{files.SOURCE_KEY},year,artist",
                  files.parse_year_labels_csv),
    }
    parts = []
    for name, (cells, sep, number, header, parse) in inputs.items():
        _write_lines(_spoilt_lines(orders, cells, sep, number), f"{base}/{name}", header)
        parsed = parse(spark, f"{base}/{name}")
        key = F.split("line", sep)[0].alias(KEY)
        both = parsed.rows.select(KEY, F.lit("kept").alias("reason")).unionByName(
            parsed.quarantine.select(key, "reason"))
        parts.append(both.groupBy("reason").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(KEY).cast("bigint")).alias("key_sum"))
            .select(F.lit(name).alias("input"), "*"))
    return functools.reduce(DataFrame.unionByName, parts)


def assembled_features(spark, sf_dir):
    """the assembled vector, one column per slot."""
    joined = _joined(spark, sf_dir)
    names = prepare.feature_columns(joined)
    assembled = prepare.assemble(joined, names)
    return indexing.vector_slots(assembled, prepare.FEATURES, _slots(len(names)))


def label_index(spark, sf_dir):
    """F2 + A2: fitted label order over all joined rows."""
    model = indexing.fit_label_indexer(_joined(spark, sf_dir))
    return indexing.label_index_frame(spark, model)


def _prepared(spark, sf_dir):
    joined = _joined(spark, sf_dir)
    names = prepare.feature_columns(joined)
    return prepare.assemble(joined, names), names


def feature_categories(spark, sf_dir):
    """F3 + A3: category maps of the slots with at most 4 distinct values."""
    assembled, names = _prepared(spark, sf_dir)
    model = indexing.fit_feature_indexer(assembled)
    return indexing.category_frame(spark, model, names)


def indexed_features(spark, sf_dir):
    """the indexed vector, one column per slot."""
    assembled, names = _prepared(spark, sf_dir)
    model = indexing.fit_feature_indexer(assembled)
    out = model.transform(assembled).select(KEY, indexing.INDEXED_FEATURES)
    return indexing.vector_slots(out, indexing.INDEXED_FEATURES, _slots(len(names)))


def label_decode_roundtrip(spark, sf_dir):
    """F4 ∘ F2: label → index → label."""
    joined = _joined(spark, sf_dir).select(KEY, LABEL)
    model = indexing.fit_label_indexer(joined)
    decode = IndexToString(inputCol=indexing.INDEXED_LABEL, outputCol="decoded_label",
                           labels=model.labels)
    out = decode.transform(model.transform(joined))
    return out.select(KEY, LABEL, F.col(indexing.INDEXED_LABEL).alias("label_idx"),
                      "decoded_label")


def key_split(spark, sf_dir):
    """R2, key-derived 70 / 30 over the year join."""
    return prepare.key_split(year_join(spark, sf_dir), YEAR_TRAIN_FRACTION) \
        .select(KEY, files.YEAR, SUBSET)


def fold_counts(spark, sf_dir):
    """TRAIN rows per fold."""
    train = prepare.subset_rows(_joined(spark, sf_dir), prepare.TRAIN)
    folded = prepare.assign_folds(train, CV_FOLDS)
    return folded.groupBy(prepare.FOLD).agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- models

def logreg_default_predictions(spark, sf_dir):
    """M1 + M7 at defaults 10 / 0.3 / 0.8 (SQL*)."""
    run = _logreg_run(spark, sf_dir)
    return run.predictions.select(KEY, LABEL,
                                  F.col(indexing.PREDICTED_LABEL).alias("predicted_label"))


def accuracy_test_error(spark, sf_dir):
    """A4 + P7 of the default LogReg job (SQL*)."""
    return _logreg_run(spark, sf_dir).accuracy()


def per_class_accuracy(spark, sf_dir):
    """Accuracy per true genre of the default LogReg job (SQL*)."""
    return evaluate.per_class_accuracy(_logreg_run(spark, sf_dir).predictions)


def sample_predictions(spark, sf_dir):
    """First five TEST predictions by key (SQL*)."""
    run = _logreg_run(spark, sf_dir)
    # the vector column is left out of the compared result
    out = evaluate.sample_predictions(run.predictions,
                                      columns=(KEY, indexing.PREDICTED_LABEL, LABEL))
    return out.withColumnRenamed(indexing.PREDICTED_LABEL, "predicted_label")


def embedding_logreg_accuracy(spark, sf_dir):
    """M1 on the 64-float embedding input (array column → vector) (SQL*)."""
    return _logreg_run(spark, sf_dir, fixtures.embedding_inputs(spark, sf_dir)).accuracy()


def coefficients(spark, sf_dir):
    """M4: coefficient matrix and intercepts of the default LogReg (rows)."""
    run = _logreg_run(spark, sf_dir)
    lr = models.estimator_stage(run.model)
    run.release()
    return models.coefficient_rows(spark, lr, run.label_model.labels, run.feature_names)


def forest_predictions(spark, sf_dir):
    """M2 + M7: random forest, 10 trees, depth 5, fixed seed (rows)."""
    run = jobs.run_genre_forest(_orders(spark, sf_dir), FOREST_TREES)
    return run.predictions.select(KEY, LABEL,
                                  F.col(indexing.PREDICTED_LABEL).alias("predicted_label"))


def forest_test_error(spark, sf_dir):
    """A4 + P7 of the forest job (rows)."""
    return jobs.run_genre_forest(_orders(spark, sf_dir), FOREST_TREES).accuracy()


def _year_ols(spark, sf_dir, split: str | None):
    labels = fixtures.order_year_labels(spark, sf_dir)
    feats = fixtures.order_features(spark, sf_dir)
    if split is None:
        prepared, names = jobs.prepare_year(labels, feats, [OLS_FEATURE], name="year_ols")
        model = models.linear_regression(reg_param=0.0, elastic_net=0.0).fit(prepared)
        return prepared, model
    run = jobs.run_year(labels, feats, reg_param=0.0, elastic_net=0.0,
                        train_fraction=YEAR_TRAIN_FRACTION, split=split,
                        feature_cols=[OLS_FEATURE], name="year_ols")
    return run, run.model


def ols_year(spark, sf_dir):
    """M3 + M5 + A6 at ``regParam = 0``: year ~ qty on all joined rows (SQL*)."""
    prepared, model = _year_ols(spark, sf_dir, None)
    s = model.summary
    row = (float(model.coefficients[0]), float(model.intercept), float(s.rootMeanSquaredError),
           float(s.r2), int(s.numInstances))
    out = spark.createDataFrame([row], "slope double, intercept double, rmse double, "
                                       "r2 double, n_rows bigint")
    return out.select(rounded("slope", 8), rounded("intercept", 6), rounded("rmse", 6),
                      rounded("r2", 8), "n_rows")


def regression_metrics(spark, sf_dir):
    """A5 + A6: OLS year ~ qty fitted on the key-split TRAIN rows; RMSE and r2
    on TRAIN and on TEST (SQL*)."""
    run, _ = _year_ols(spark, sf_dir, "key")
    scored = run.model.transform(run.prepared)
    parts = []
    for subset in (prepare.TRAIN, prepare.TEST):
        m = evaluate.regression_metrics(prepare.subset_rows(scored, subset), decimals=6)
        parts.append(m.select(F.lit(subset).alias(SUBSET), "*"))
    return parts[0].unionByName(parts[1])


def year_coefficients(spark, sf_dir):
    """M3 + M5 at the reference defaults 10 / 0.3 / 0.8 with a seeded random
    70 / 30 split, all five features (rows)."""
    run = jobs.run_year(fixtures.order_year_labels(spark, sf_dir),
                        fixtures.order_features(spark, sf_dir))
    return models.linear_coefficient_rows(spark, run.model, run.feature_names)


def year_job(spark, sf_dir):
    """Entry C as the reference reports it: training RMSE / r2 / iterations from
    the summary (A6, M6) and RMSE on the held-out rows (A5), defaults
    10 / 0.3 / 0.8, seeded random 70 / 30 split (rows)."""
    run = jobs.run_year(fixtures.order_year_labels(spark, sf_dir),
                        fixtures.order_features(spark, sf_dir))
    t = run.training_metrics().first()
    m = run.test_metrics().first()
    return spark.createDataFrame(
        [(float(t.rmse), float(t.r2), int(t.total_iterations), int(m.n_rows), float(m.rmse))],
        "train_rmse double, train_r2 double, total_iterations int, n_test bigint, "
        "test_rmse double")


def objective_history(spark, sf_dir):
    """M6 of the default year job (rows)."""
    run = jobs.run_year(fixtures.order_year_labels(spark, sf_dir),
                        fixtures.order_features(spark, sf_dir))
    return models.objective_history_rows(spark, run.model)


# ---------------------------------------------------------------- tuning

def _logreg_cv(spark, sf_dir):
    return jobs.run_genre_logreg_cv(_orders(spark, sf_dir), num_folds=CV_FOLDS,
                                    **LOGREG_CV_GRID)


def _metric_columns(df):
    return df.select("grid_id", *tuning.LOGREG_GRID_PARAMS, rounded("avg_metric", 8),
                     rounded("std_metric", 8))


def logreg_cv_grid(spark, sf_dir):
    """G1 + G3 + G4 + A7: LogReg grid, 3 key folds, average and spread of
    fold accuracy per point (SQL*)."""
    run = _logreg_cv(spark, sf_dir)
    run.release()
    return _metric_columns(run.cv_results)


def best_params(spark, sf_dir):
    """A8 / G5 over the LogReg grid results (SQL*)."""
    return tuning.best_params(logreg_cv_grid(spark, sf_dir))


def logreg_cv_test_error(spark, sf_dir):
    """Best CV model scored on TEST (SQL*)."""
    return _logreg_cv(spark, sf_dir).accuracy()


def forest_cv(spark, sf_dir):
    """G2 + G3 + G4 for the forest grid (rows)."""
    run = jobs.run_genre_forest_cv(_orders(spark, sf_dir), num_folds=CV_FOLDS, **FOREST_CV_GRID)
    run.release()
    return run.cv_results


# ---------------------------------------------------------------- live models
#
# One feature with two categories makes the model saturated: what it must
# predict is each category's majority among its training rows, which SQL can
# say, and a wrong gradient, penalty or refit shows.

def _banded(spark, sf_dir):
    """Label = quantity band, the only feature = number of line statuses."""
    features = fixtures.order_features(spark, sf_dir)
    band = F.when(F.col("qty") < 60, "light").when(F.col("qty") < 120, "medium").otherwise("heavy")
    return {"features": features.select(KEY, "n_ls"),
            "labels": features.select(KEY, band.alias(LABEL)),
            "splits": fixtures.order_splits(spark, sf_dir)}


def _predicted(run):
    return run.predictions.select(KEY, LABEL,
                                  F.col(indexing.PREDICTED_LABEL).alias("predicted_label"))


def logreg_saturated(spark, sf_dir):
    """M1 + M7: converged logistic regression without penalty on one feature."""
    return _predicted(jobs.run_genre_logreg(_banded(spark, sf_dir), max_iter=200, reg_param=0.0,
                                            elastic_net=0.0))


def forest_stump(spark, sf_dir):
    """M2 + M7: one tree of depth 1 on all rows and all features."""
    stump = models.random_forest(1, max_depth=1, feature_subset_strategy="all", bootstrap=False)
    return _predicted(jobs.run_genre(_banded(spark, sf_dir), stump))


# Depth-2 trees on all features: prices in bands and enough bins, so that every
# midpoint is a candidate split and no row is sampled for them.
PRICE_BAND_CENTS = 2_000_000
TREE_BINS = 512


def _price_banded(spark, sf_dir, target):
    """The orders with prices in bands; for the quantity band as label, without quantity."""
    own = _orders(spark, sf_dir)
    features = own["features"].withColumn(
        "cents", F.floor(F.col("cents") / PRICE_BAND_CENTS).cast("double"))
    if target == "priority":
        return dict(own, features=features)
    return dict(_banded(spark, sf_dir), features=features.drop("qty"))


def tree_depth2(spark, sf_dir):
    """M2 + M7 + F3: one tree of depth 2 for two targets and both impurities, with
    continuous features and categorical ones of two and three values."""
    parts = []
    for target in ("priority", "band"):
        prepared = jobs.prepare_genre(_price_banded(spark, sf_dir, target), name="tree")
        for impurity in models.CLASSIFIER_IMPURITIES:
            tree = models.random_forest(1, max_depth=2, feature_subset_strategy="all",
                                        impurity=impurity, max_bins=TREE_BINS, bootstrap=False)
            parts.append(_predicted(jobs.run_genre(None, tree, prepared=prepared)).select(
                F.lit(target).alias("target"), F.lit(impurity).alias("impurity"), "*"))
    return functools.reduce(DataFrame.unionByName, parts)


def tree_cv(spark, sf_dir):
    """G2 + G3 + G4 + A7 for trees: depth and impurity grid over key folds, no sampling."""
    est = models.random_forest(1, feature_subset_strategy="all", max_bins=TREE_BINS,
                               bootstrap=False)
    grid = tuning.forest_grid(est, [1], [TREE_BINS], [1, 2], models.CLASSIFIER_IMPURITIES, ["all"])
    run = jobs.run_genre_cv(_price_banded(spark, sf_dir, "priority"), est, grid,
                            tuning.FOREST_GRID_PARAMS, CV_FOLDS)
    run.release()
    return run.cv_results.select("grid_id", *tuning.FOREST_GRID_PARAMS, rounded("avg_metric", 8))


def _saturated_cv(spark, sf_dir):
    return jobs.run_genre_logreg_cv(_banded(spark, sf_dir), max_iter=[100], reg_param=[0.5, 0.0],
                                    elastic_net=[0.0, 1.0], num_folds=CV_FOLDS)


def logreg_cv_saturated(spark, sf_dir):
    """G1 + G3 + G4 + A7 with grid points that differ: a strong penalty predicts
    the majority, none predicts each category's majority."""
    run = _saturated_cv(spark, sf_dir)
    run.release()
    return run.cv_results.select(
        "grid_id", *tuning.LOGREG_GRID_PARAMS, rounded("avg_metric", 8))


def best_params_saturated(spark, sf_dir):
    """A8 / G5 where the best point is not the first."""
    return tuning.best_params(logreg_cv_saturated(spark, sf_dir))


def cv_test_error_saturated(spark, sf_dir):
    """The best point refitted on TRAIN and scored on TEST."""
    return _saturated_cv(spark, sf_dir).accuracy()


# ---------------------------------------------------------------- certificates
#
# Converged fits on all five features, at penalties that leave weights; what
# must hold at the optimum is recomputed from the rows (operators/certify.py).

def _converged_logreg(spark, sf_dir):
    est = models.logistic_regression(CONVERGED_ITERATIONS, *LOGREG_PENALTY, tol=CONVERGED_TOL)
    run = jobs.run_genre(_orders(spark, sf_dir), est)
    train = models.index_stages(run.label_model, run.feature_model).transform(run.train)
    return run, models.estimator_stage(run.model), train


def logreg_certificate(spark, sf_dir):
    """M1 + M4: every weight and intercept meets the optimality conditions."""
    run, model, train = _converged_logreg(spark, sf_dir)
    found = certify.certify_logistic(train, model, *LOGREG_PENALTY)
    run.release()  # what is returned no longer reads the staged rows
    return certify.certificate_rows(spark, found, run.label_model.labels, run.feature_names)


def _year_prepared(spark, sf_dir):
    return jobs.prepare_year(fixtures.order_year_labels(spark, sf_dir),
                             fixtures.order_features(spark, sf_dir))


def ols_year_all(spark, sf_dir):
    """M3 + M5: least squares on all five features; weights times their feature's spread."""
    prepared, names = _year_prepared(spark, sf_dir)
    model = models.linear_regression(reg_param=0.0, elastic_net=0.0).fit(prepared)
    spread = certify.moments(prepared).std[:-1]
    rows = [(n, float(w * s)) for n, w, s in
            zip(names, model.coefficients.toArray(), spread, strict=True)]
    rows.append(("(intercept)", float(model.intercept)))
    release(prepared)
    out = spark.createDataFrame(rows, "feature string, weight double")
    return out.select("feature", rounded("weight", 6))


def year_certificate(spark, sf_dir):
    """M3 + M5: the year model at the reference's penalty, which leaves no weight,
    and at a light one, which leaves some."""
    prepared, names = _year_prepared(spark, sf_dir)
    parts = []
    for name, penalty, fit in (("reference", YEAR_PENALTY, {}), ("light", YEAR_LIGHT_PENALTY, {
            "max_iter": CONVERGED_ITERATIONS, "tol": CONVERGED_TOL})):
        model = models.linear_regression(reg_param=penalty[0], elastic_net=penalty[1],
                                         **fit).fit(prepared)
        found = certify.certify_linear(prepared, model, *penalty)
        parts.append(certify.certificate_rows(spark, found, [name], names).withColumnRenamed(
            LABEL, "penalty"))
    release(prepared)
    return parts[0].unionByName(parts[1])


def objective_certificate(spark, sf_dir):
    """M6: the objective recomputed from the rows is the history's last value, the
    history never rises, and some but not all weights are zero."""
    run, model, train = _converged_logreg(spark, sf_dir)
    logistic = certify.certify_logistic(train, model, *LOGREG_PENALTY)
    prepared, _ = _year_prepared(spark, sf_dir)
    year = models.linear_regression(CONVERGED_ITERATIONS, *YEAR_LIGHT_PENALTY,
                                    tol=CONVERGED_TOL).fit(prepared)
    linear = certify.certify_linear(prepared, year, *YEAR_LIGHT_PENALTY)
    rows = []
    for name, n, fitted, found, weights in (
            ("logreg", run.n_train, model, logistic, model.coefficientMatrix.toArray()),
            ("year", prepared.count(), year, linear, year.coefficients.toArray())):
        history = list(fitted.summary.objectiveHistory)
        rows.append((name, n, certify.history_agrees(history, found.objective),
                     0 < int((weights != 0).sum()) < weights.size))
    run.release()
    release(prepared)
    return spark.createDataFrame(
        rows, "model string, n_rows bigint, agrees boolean, sparse boolean")


# ---------------------------------------------------------------- experiments

def experiment_sweep(spark, sf_dir):
    """E1-E3 + S8: a sweep over two feature sets x two algorithms (rows)."""
    manifest = experiments.fixture_manifest(spark, sf_dir)
    return experiments.run_sweep(spark, manifest, sf_dir)


def sweep_summary(spark, sf_dir):
    """E7 over the sweep results (rows)."""
    return experiments.summarize(experiment_sweep(spark, sf_dir))


def sweep_results(spark, sf_dir):
    """E3 + E5 + S8: the order experiments swept twice into one results table and
    read back; the second sweep finds every run recorded."""
    path = stage_path(spark, "results")
    manifest = experiments.fixture_manifest(spark, sf_dir).where(
        F.col("feature_set") == "orders")
    for _ in range(2):
        experiments.run_sweep(spark, manifest, sf_dir, results_path=path)
    return experiments.read_results(spark, path).select(
        "run_id", "app_name", "algorithm", "status", "n_train", "n_attempts")


QUERIES = {
    "track_join": track_join,
    "year_join": year_join,
    "subset_counts": subset_counts,
    "subset_label_counts": subset_label_counts,
    "train_rows": train_rows,
    "test_rows": test_rows,
    "text_inputs_join": text_inputs_join,
    "quarantined_rows": quarantined_rows,
    "assembled_features": assembled_features,
    "label_index": label_index,
    "feature_categories": feature_categories,
    "indexed_features": indexed_features,
    "label_decode_roundtrip": label_decode_roundtrip,
    "key_split": key_split,
    "fold_counts": fold_counts,
    "logreg_default_predictions": logreg_default_predictions,
    "accuracy_test_error": accuracy_test_error,
    "per_class_accuracy": per_class_accuracy,
    "sample_predictions": sample_predictions,
    "embedding_logreg_accuracy": embedding_logreg_accuracy,
    "coefficients": coefficients,
    "forest_predictions": forest_predictions,
    "forest_test_error": forest_test_error,
    "ols_year": ols_year,
    "regression_metrics": regression_metrics,
    "year_coefficients": year_coefficients,
    "year_job": year_job,
    "objective_history": objective_history,
    "logreg_cv_grid": logreg_cv_grid,
    "best_params": best_params,
    "logreg_cv_test_error": logreg_cv_test_error,
    "forest_cv": forest_cv,
    "logreg_saturated": logreg_saturated,
    "forest_stump": forest_stump,
    "tree_depth2": tree_depth2,
    "tree_cv": tree_cv,
    "logreg_cv_saturated": logreg_cv_saturated,
    "best_params_saturated": best_params_saturated,
    "cv_test_error_saturated": cv_test_error_saturated,
    "logreg_certificate": logreg_certificate,
    "ols_year_all": ols_year_all,
    "year_certificate": year_certificate,
    "objective_certificate": objective_certificate,
    "experiment_sweep": experiment_sweep,
    "sweep_summary": sweep_summary,
    "sweep_results": sweep_results,
}
