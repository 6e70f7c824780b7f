"""The reference's five ML jobs as composable Spark plans.

Genre jobs (fixed partition, with or without grid search) share one skeleton:

    features packed into one array → splits ⋈ labels ⋈ features → vector
      → stage (Parquet, by subset) → one pass for subset sizes + label order
      → category indexer → pipeline fit on TRAIN → score TEST → metrics

The year job: features packed → labels ⋈ features → vector → stage → split →
linear regression → training summary + test RMSE.

Each prepared frame is written once to the shared checkpoint folder
(:func:`trackml.session.stage`) and read back, partitioned by ``subset`` so the
TRAIN/TEST filters prune whole directories; every later pass (indexer fits,
optimiser iterations, folds, scoring) reads it instead of re-running scans and
joins, and survives the loss of an executor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackml.operators import evaluate, indexing, models, prepare, tuning
from trackml.operators.prepare import SUBSET, TEST, TRAIN
from trackml.session import release, stage
from trackml.sources.files import KEY, LABEL, YEAR


@dataclass
class GenreRun:
    prepared: DataFrame
    train: DataFrame
    test: DataFrame
    n_train: int
    n_test: int
    feature_names: list[str]
    label_model: object
    feature_model: object
    model: object
    predictions: DataFrame
    cv_results: DataFrame | None = None
    cv_model: object | None = None

    def release(self) -> list[str]:
        """Free the staged input once the run's results are collected."""
        return release(self.prepared)

    def accuracy(self) -> DataFrame:
        """A4 + P7 with the counts of the run: one row."""
        acc = evaluate.accuracy(self.predictions)
        return acc.select(F.lit(self.n_train).cast("bigint").alias("n_train"),
                          F.col("n_rows").alias("n_test"), "n_correct", "accuracy", "test_error")


def stage_features(features: DataFrame, name: str, feature_cols: list[str] | None = None
                   ) -> tuple[DataFrame, list[str]]:
    """P5 → F1 (packed), staged, with the slot names.

    A table on this side of the joins: a hot track's features are repeated from
    files, and several prepared inputs can share it.
    """
    packed, names = prepare.pack_features(features, feature_cols)
    return stage(packed, f"{name}_features"), names


def prepare_genre(inputs: dict[str, DataFrame], handle_invalid: str = "error",
                  num_folds: int | None = None, name: str = "genre",
                  path: str | None = None, fold_method: str = "auto",
                  packed: tuple[DataFrame, list[str]] | None = None
                  ) -> tuple[DataFrame, list[str]]:
    """P5 → F1 (packed) → J1 → F1 (vector) (→ R3) → staged frame
    ``track_id, subset, label, [fold,] features``.

    The feature columns are packed into one array before the join and turned
    into the vector after it, with the invalid-value rule applied to joined
    rows only (the same rows the reference's assembler sees).
    ``packed`` are features that :func:`stage_features` has staged; they are
    left for others.
    """
    features, names = packed or stage_features(inputs["features"], name)
    joined = prepare.join_tracks(inputs["splits"], inputs["labels"], features)
    assembled = prepare.vectorize(joined, names, handle_invalid=handle_invalid)
    if num_folds:
        assembled = prepare.assign_folds(assembled, num_folds, method=fold_method)
    staged = stage(assembled, name, partition_by=[SUBSET], path=path)
    if packed is None:
        release(features)
    slot_names = indexing.slot_names(staged) or names
    return staged, slot_names


OTHER = "OTHER"


def subset_label_counts(prepared: DataFrame) -> list:
    """A1 + A2 (+ R3 fold sizes) in one pass: rows per (subset, label[, fold]).

    Subset values other than TRAIN/TEST (never used, as in the reference) are
    folded into one group, so the result is at most 3 x classes (x folds) rows.
    """
    subset = F.when(F.col(SUBSET).isin(TRAIN, TEST), F.col(SUBSET)).otherwise(F.lit(OTHER))
    keys = [subset.alias(SUBSET), F.col(LABEL)]
    if prepare.FOLD in prepared.columns:
        keys.append(F.col(prepare.FOLD))
    return prepared.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()


def check_folds(counts, num_folds: int) -> None:
    """Every fold must hold TRAIN rows (integer keys with a common factor of
    ``num_folds`` would put them all in one fold under ``key mod k``)."""
    sizes = {f: 0 for f in range(num_folds)}
    for r in counts:
        if r[SUBSET] == TRAIN:
            sizes[r[prepare.FOLD]] = sizes.get(r[prepare.FOLD], 0) + r["n"]
    empty = [f for f, n in sizes.items() if n == 0]
    if empty:
        raise ValueError(f"folds {empty} have no TRAIN rows; the key values are not spread "
                         f"over {num_folds} folds; use fold_method='hash'")


def subset_sizes(counts) -> dict[str, int]:
    """A1: rows per subset value, from :func:`subset_label_counts` rows."""
    sizes: dict[str, int] = {}
    for r in counts:
        sizes[r[SUBSET]] = sizes.get(r[SUBSET], 0) + r["n"]
    return sizes


def _label_counts(rows, subsets) -> dict[str, int]:
    counts: dict[str, int] = {}
    for r in rows:
        if r[LABEL] is not None and r[SUBSET] in subsets:
            counts[r[LABEL]] = counts.get(r[LABEL], 0) + r["n"]
    return counts


def fit_indexers(prepared: DataFrame, train: DataFrame, index_on: str = "all", counts=None,
                 feature_model=None):
    """F2 + F3.  ``all`` (reference behaviour) fits on train and test rows;
    ``train`` fits on TRAIN only and keeps unseen labels/categories.

    ``counts`` are :func:`subset_label_counts` rows when already computed; the
    label order is then taken from them instead of another pass.  So is
    ``feature_model``, the category indexer of all rows.
    """
    if index_on not in ("all", "train"):
        raise ValueError("index_on must be 'all' or 'train'")
    rows = counts if counts is not None else subset_label_counts(prepared)
    if index_on == "all":
        label_model = indexing.label_model_from_counts(
            _label_counts(rows, (TRAIN, TEST, OTHER, None)))
        # a copy of its own for each of the runs that share it
        return label_model, (indexing.fit_feature_indexer(prepared) if feature_model is None
                             else feature_model.copy())
    label_model = indexing.label_model_from_counts(_label_counts(rows, (TRAIN,)),
                                                   handle_invalid="keep")
    return label_model, indexing.fit_feature_indexer(train, handle_invalid="keep")


def measure_genre(prepared: DataFrame) -> tuple[list, object]:
    """The passes over all rows that runs over one prepared frame can share:
    subset and label counts, and the category indexer."""
    return subset_label_counts(prepared), indexing.fit_feature_indexer(prepared)


def _setup(inputs, handle_invalid, num_folds, index_on, name, prepared=None,
           fold_method="auto", measured=None):
    if prepared is None:
        prepared, names = prepare_genre(inputs, handle_invalid, num_folds, name,
                                        fold_method=fold_method)
    else:
        prepared, names = prepared
        if num_folds and prepare.FOLD not in prepared.columns:
            prepared = prepare.assign_folds(prepared, num_folds, method=fold_method)
    train, test = prepare.split_by_subset(prepared)
    counts = subset_label_counts(prepared) if num_folds or measured is None else measured[0]
    if num_folds:
        check_folds(counts, num_folds)
    sizes = subset_sizes(counts)
    label_model, feature_model = fit_indexers(prepared, train, index_on, counts,
                                              measured and measured[1])
    return prepared, names, train, test, sizes, label_model, feature_model


def run_genre(inputs: dict[str, DataFrame] | None, estimator, handle_invalid: str = "error",
              index_on: str = "all", name: str = "genre",
              prepared: tuple[DataFrame, list[str]] | None = None,
              measured: tuple[list, object] | None = None) -> GenreRun:
    """Entry A (LogReg or RF on a fixed partition).

    ``prepared`` is an already staged ``(frame, feature names)`` pair from
    :func:`prepare_genre`, shared by several runs over the same inputs, and
    ``measured`` what :func:`measure_genre` found in it.
    """
    prepared, names, train, test, sizes, label_model, feature_model = _setup(
        inputs, handle_invalid, None, index_on, name, prepared, measured=measured)
    pipeline = models.classification_pipeline(label_model, feature_model, estimator)
    model: PipelineModel = pipeline.fit(train)
    predictions = model.transform(test)
    return GenreRun(prepared, train, test, sizes.get(TRAIN, 0), sizes.get(TEST, 0), names,
                    label_model, feature_model, model, predictions)


def run_genre_logreg(inputs: dict[str, DataFrame], max_iter: int = 10, reg_param: float = 0.3,
                     elastic_net: float = 0.8, **kw) -> GenreRun:
    return run_genre(inputs, models.logistic_regression(max_iter, reg_param, elastic_net), **kw)


def run_genre_forest(inputs: dict[str, DataFrame], num_trees: int, max_depth: int = 5,
                     feature_subset_strategy: str = "auto", impurity: str = "gini",
                     seed: int = models.DEFAULT_SEED, **kw) -> GenreRun:
    est = models.random_forest(num_trees, max_depth, feature_subset_strategy, impurity, seed=seed)
    return run_genre(inputs, est, **kw)


def run_genre_cv(inputs: dict[str, DataFrame], estimator, grid: list[dict],
                 param_names: tuple[str, ...], num_folds: int = tuning.DEFAULT_FOLDS,
                 parallelism: int = tuning.PARALLEL_FITS, handle_invalid: str = "error",
                 index_on: str = "all",
                 seed: int = models.DEFAULT_SEED, name: str = "genre_cv",
                 prepared: tuple[DataFrame, list[str]] | None = None,
                 fold_method: str = "auto",
                 measured: tuple[list, object] | None = None) -> GenreRun:
    """Entry B: grid search with k-fold CV on TRAIN, best point refitted, TEST scored.

    Folds come from the key (``fold_method``, see
    :func:`trackml.functions.columns.key_bucket`).  The fitted indexers are
    applied to TRAIN before the folds, so the tuned pipeline is only
    estimator + decoder and the fold frames that ``CrossValidator`` caches
    already hold indexed rows: no fit re-runs the indexers.  ``run.model`` is
    the full pipeline (indexers, best model, decoder); ``run.cv_model`` the
    ``CrossValidatorModel``.
    """
    prepared, names, train, test, sizes, label_model, feature_model = _setup(
        inputs, handle_invalid, num_folds, index_on, name, prepared, fold_method, measured)
    indexed = models.index_stages(label_model, feature_model).transform(train)
    tuned = Pipeline(stages=[estimator, indexing.label_decoder(label_model)])
    cv_model = tuning.cross_validate(tuned, grid, indexed, num_folds, parallelism, seed)
    best = cv_model.bestModel
    model = PipelineModel(stages=[label_model, feature_model, *best.stages])
    predictions = model.transform(test)
    results = tuning.grid_results(prepared.sparkSession, cv_model, param_names)
    return GenreRun(prepared, train, test, sizes.get(TRAIN, 0), sizes.get(TEST, 0), names,
                    label_model, feature_model, model, predictions, cv_results=results,
                    cv_model=cv_model)


def run_genre_logreg_cv(inputs, max_iter=(10,), reg_param=(0.3,), elastic_net=(0.2,),
                        num_folds: int = 3, **kw) -> GenreRun:
    est = models.logistic_regression()
    grid = tuning.logreg_grid(est, max_iter, reg_param, elastic_net)
    return run_genre_cv(inputs, est, grid, tuning.LOGREG_GRID_PARAMS, num_folds, **kw)


def run_genre_forest_cv(inputs, num_trees, max_depth, max_bins, impurity,
                        feature_subset_strategy=("auto",), num_folds: int = tuning.DEFAULT_FOLDS,
                        seed: int = models.DEFAULT_SEED, **kw) -> GenreRun:
    est = models.random_forest(1, seed=seed)
    grid = tuning.forest_grid(est, num_trees, max_bins, max_depth, impurity,
                              feature_subset_strategy)
    return run_genre_cv(inputs, est, grid, tuning.FOREST_GRID_PARAMS, num_folds, seed=seed, **kw)


@dataclass
class YearRun:
    prepared: DataFrame
    train: DataFrame
    test: DataFrame
    feature_names: list[str]
    model: object
    predictions: DataFrame

    def release(self) -> list[str]:
        """Free the staged input once the run's results are collected."""
        return release(self.prepared)

    def training_metrics(self) -> DataFrame:
        """RMSE and r2 on the training rows, from the model's summary."""
        s = self.model.summary
        spark = self.prepared.sparkSession
        return spark.createDataFrame(
            [(float(s.rootMeanSquaredError), float(s.r2), int(s.totalIterations))],
            "rmse double, r2 double, total_iterations int")

    def test_metrics(self) -> DataFrame:
        """A5 on the held-out rows."""
        return evaluate.regression_metrics(self.predictions)


def prepare_year(labels: DataFrame, features: DataFrame, feature_cols: list[str] | None = None,
                 handle_invalid: str = "error", split: str = "random",
                 train_fraction: float = 0.7, name: str = "year",
                 packed: tuple[DataFrame, list[str]] | None = None
                 ) -> tuple[DataFrame, list[str]]:
    """``packed`` are features that :func:`stage_features` has staged; they are left for others."""
    staged, names = packed or stage_features(features, name, feature_cols)
    joined = prepare.join_year(labels, staged)
    assembled = prepare.vectorize(joined, names, handle_invalid=handle_invalid)
    assembled = prepare.select_rename(assembled, [KEY, YEAR, prepare.FEATURES], {YEAR: LABEL})
    if split in ("key", "hash"):
        method = "hash" if split == "hash" else "auto"
        out = stage(prepare.key_split(assembled, train_fraction, method=method), name,
                    partition_by=[SUBSET])
    else:
        out = stage(assembled, name)
    if packed is None:
        release(staged)
    return out, names


def run_year(labels: DataFrame | None, features: DataFrame | None, max_iter: int = 10, reg_param: float = 0.3,
             elastic_net: float = 0.8, train_fraction: float = 0.7, split: str = "random",
             seed: int = models.DEFAULT_SEED, feature_cols: list[str] | None = None,
             solver: str = "auto", handle_invalid: str = "error", name: str = "year",
             prepared: tuple[DataFrame, list[str]] | None = None) -> YearRun:
    """Entry C.

    ``split="random"`` is the reference's ``randomSplit`` (seeded here).  Spark
    sorts every partition by all orderable columns to make it deterministic,
    once per side.  ``split="hash"`` puts a row in TRAIN when the xxhash64 of
    its key falls in the first ``train_fraction`` of 100 buckets: a uniform
    split with no sort, stored as a partition column of the staged table.
    ``split="key"`` uses ``key mod 100`` for integer keys (reproducible in SQL).
    ``prepared`` is what :func:`prepare_year` staged for the same split, shared
    by several runs.
    """
    if split not in ("random", "key", "hash"):
        raise ValueError("split must be 'random', 'key' or 'hash'")
    prepared, names = prepared or prepare_year(labels, features, feature_cols, handle_invalid,
                                               split, train_fraction, name)
    if split == "random":
        train, test = prepare.random_split(prepared, train_fraction, seed)
    else:
        train, test = prepare.split_by_subset(prepared)
    estimator = models.linear_regression(max_iter, reg_param, elastic_net, solver=solver)
    model = estimator.fit(train)
    return YearRun(prepared, train, test, names, model, model.transform(test))
