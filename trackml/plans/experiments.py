"""Experiment manifests, parameter defaults, readiness check, sweeps.

The reference keeps one text config per experiment and one ``spark-submit``
per config.  Here an experiment is one row of a manifest DataFrame; a sweep is
one Spark application that runs the manifest's rows (a few at a time), each a
set of distributed jobs, and keeps one result row per run (committed to a
results table when a path is given).  The manifest has one row per experiment,
so it is small however large the data is.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import time
import traceback
from collections import Counter
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackml.operators import models, tuning
from trackml.plans import jobs, results
from trackml.session import release, stage_path
from trackml.sources import files, fixtures

ALGORITHMS = ("logreg", "forest", "logreg_cv", "forest_cv", "year")

# Per-algorithm defaults of the reference jobs (fixed values); a missing
# ``num_trees`` for a forest has no default and rejects the row.
PARAM_DEFAULTS = {
    "max_iter": 10,
    "reg_param": 0.3,
    "elastic_net": 0.8,
    "max_depth": 5,
    "feature_subset_strategy": "auto",
    "impurity": "gini",
    "max_bins": 32,
    "train_split": 0.7,
    "num_folds": 10,
}
PARAM_COLUMNS = ("max_iter", "reg_param", "elastic_net", "num_trees", "max_depth",
                 "feature_subset_strategy", "impurity", "max_bins", "train_split", "num_folds")
# Grid-search jobs have no default for their parameter lists (only the number
# of folds has one): a missing value rejects the row.
GRID_REQUIRED = {
    "logreg_cv": ("max_iter", "reg_param", "elastic_net"),
    "forest_cv": ("num_trees", "max_depth", "max_bins", "impurity", "feature_subset_strategy"),
}

# Parameter lists of grid-search rows; a list takes the place of the scalar.
GRID_LISTS = {
    "max_iter": "max_iters", "reg_param": "reg_params", "elastic_net": "elastic_nets",
    "num_trees": "num_trees_list", "max_depth": "max_depths", "max_bins": "max_bins_list",
    "impurity": "impurities", "feature_subset_strategy": "feature_subset_strategies",
}

MANIFEST_SCHEMA = T.StructType([
    T.StructField("run_id", T.IntegerType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("feature_set", T.StringType()),
    T.StructField("label_set", T.StringType()),
    T.StructField("split_set", T.StringType()),
    T.StructField("features_path", T.StringType()),
    T.StructField("labels_path", T.StringType()),
    T.StructField("splits_path", T.StringType()),
    T.StructField("max_iter", T.IntegerType()),
    T.StructField("reg_param", T.DoubleType()),
    T.StructField("elastic_net", T.DoubleType()),
    T.StructField("num_trees", T.IntegerType()),
    T.StructField("max_depth", T.IntegerType()),
    T.StructField("feature_subset_strategy", T.StringType()),
    T.StructField("impurity", T.StringType()),
    T.StructField("max_bins", T.IntegerType()),
    T.StructField("train_split", T.DoubleType()),
    T.StructField("num_folds", T.IntegerType()),
    T.StructField("max_iters", T.ArrayType(T.IntegerType())),
    T.StructField("reg_params", T.ArrayType(T.DoubleType())),
    T.StructField("elastic_nets", T.ArrayType(T.DoubleType())),
    T.StructField("num_trees_list", T.ArrayType(T.IntegerType())),
    T.StructField("max_depths", T.ArrayType(T.IntegerType())),
    T.StructField("max_bins_list", T.ArrayType(T.IntegerType())),
    T.StructField("impurities", T.ArrayType(T.StringType())),
    T.StructField("feature_subset_strategies", T.ArrayType(T.StringType())),
])


def build_manifest(spark: SparkSession, feature_sets: dict[str, str], label_sets: dict[str, str],
                   split_sets: dict[str, str | None], algorithms: list[str],
                   params: dict | None = None) -> DataFrame:
    """One row per (feature set, label set, split set, algorithm).

    The sets map a name to its path.  The product is taken over these short
    name lists on the driver (it is the experiment design, not data).  Unknown
    parameter names are rejected, so a typo cannot silently fall back to a
    default.
    """
    params = dict(params or {})
    columns = (*PARAM_COLUMNS, *GRID_LISTS.values())
    unknown = set(params) - set(columns)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    bad = set(algorithms) - set(ALGORITHMS)
    if bad:
        raise ValueError(f"unknown algorithms: {sorted(bad)}")
    rows = []
    combos = itertools.product(feature_sets.items(), label_sets.items(), split_sets.items(),
                               algorithms)
    for run_id, ((fs, fp), (ls, lp), (ss, sp), algo) in enumerate(combos):
        rows.append((run_id, algo, fs, ls, ss, fp, lp, sp,
                     *[params.get(c) for c in columns]))
    return spark.createDataFrame(rows, MANIFEST_SCHEMA)


def manifest_from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A manifest from explicit experiment dicts (missing keys → NULL)."""
    names = [f.name for f in MANIFEST_SCHEMA.fields]
    for r in rows:
        unknown = set(r) - set(names)
        if unknown:
            raise ValueError(f"unknown manifest keys: {sorted(unknown)}")
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], MANIFEST_SCHEMA)


def apply_defaults(manifest: DataFrame) -> DataFrame:
    """Parameter value if given, else the job's default; adds ``status``.

    ``rejected`` (as the reference's jobs would fail): a forest without
    ``num_trees``, a grid-search row missing one of its grid parameters, a
    genre job without a split set.  Everything else is ``ready``.
    """
    forest = F.col("algorithm").isin("forest", "forest_cv")
    genre = F.col("algorithm") != "year"
    no_trees = F.col("num_trees").isNull() & (
        (F.col("algorithm") == "forest") | F.col("num_trees_list").isNull())
    status = F.when(forest & no_trees, F.lit("rejected: num_trees missing"))
    for algo, names in GRID_REQUIRED.items():
        for name in names:
            status = status.when((F.col("algorithm") == algo) & F.col(name).isNull()
                                 & (F.coalesce(F.size(GRID_LISTS[name]), F.lit(0)) < 1),
                                 F.lit(f"rejected: grid list {name} missing"))
    status = (status.when(genre & F.col("splits_path").isNull(), F.lit("rejected: splits missing"))
              .otherwise(F.lit("ready")))
    out = manifest.withColumn("status", status)
    for name, default in PARAM_DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    return out


def _manifest_paths(manifest: DataFrame) -> DataFrame:
    roles = F.array(*[F.struct(F.lit(role).alias("role"), F.col(f"{role}_path").alias("path"))
                      for role in ("features", "labels", "splits")])
    return (manifest.select("run_id", F.explode(roles).alias("p"))
            .select("run_id", "p.role", "p.path")
            .where(F.col("path").isNotNull()))


def _strip_scheme(col: F.Column) -> F.Column:
    """The path without scheme and authority: listings add the name node, manifests often do not."""
    bare = F.regexp_replace(col, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.regexp_replace(bare, r"/+$", "")


def readiness(spark: SparkSession, manifest: DataFrame, roots: list[str]) -> DataFrame:
    """``run_id, role, path, status`` with status ``CHECK`` or ``MISSING``.

    ``roots`` are the data folders to list (any Hadoop URI; a missing folder
    lists nothing, so its paths are ``MISSING``).  The listing is a
    ``binaryFile`` scan that reads only file paths, never file contents; every
    listed file contributes itself and its parent folders, so a manifest path
    may name a file or a folder (e.g. a Parquet dataset).  The match is an
    equi-join on the path without scheme and authority.  Spark's file index
    holds the listed names on the driver, so roots should be the tracks' own
    folders.  A year experiment has no splits path
    and gets no splits row.
    """
    listings = []
    for root in roots:  # a handful of data folders, not data
        try:
            listings.append(spark.read.format("binaryFile")
                            .option("recursiveFileLookup", "true").load(root)
                            .select(_strip_scheme(F.col("path")).alias("file")))
        except AnalysisException:  # the folder itself is missing
            continue
    if not listings:
        listed = spark.createDataFrame([], "file string")
    else:
        listed = functools.reduce(DataFrame.unionByName, listings)
    parts = F.split(F.col("file"), "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.size(parts)),
                           lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    present = listed.select(F.explode(prefixes).alias("norm")).distinct() \
        .withColumn("present", F.lit(True))
    wanted = _manifest_paths(manifest).withColumn("norm", _strip_scheme(F.col("path")))
    joined = wanted.join(present, "norm", "left")
    return joined.select("run_id", "role", "path",
                         F.when(F.col("present"), F.lit("CHECK")).otherwise(F.lit("MISSING"))
                         .alias("status"))


def fixture_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments over the driver's tables: two feature sets x LogReg and RF,
    plus the year regression (no splits)."""
    d = sf_dir.rstrip("/")
    orders = {"feature_set": "orders", "label_set": "orders", "split_set": "orders",
              "features_path": f"{d}/lineitem.parquet", "labels_path": f"{d}/orders.parquet",
              "splits_path": f"{d}/orders.parquet"}
    emb = {"feature_set": "embeddings", "label_set": "embeddings", "split_set": "embeddings",
           "features_path": f"{d}/embeddings.parquet", "labels_path": f"{d}/embeddings.parquet",
           "splits_path": f"{d}/embeddings.parquet"}
    year = {"feature_set": "orders", "label_set": "orders_year", "split_set": None,
            "features_path": f"{d}/lineitem.parquet", "labels_path": f"{d}/orders.parquet",
            "splits_path": None}
    rows = [dict(orders, run_id=0, algorithm="logreg"),
            dict(orders, run_id=1, algorithm="forest", num_trees=10),
            dict(emb, run_id=2, algorithm="logreg"),
            dict(emb, run_id=3, algorithm="forest", num_trees=10),
            dict(year, run_id=4, algorithm="year")]
    return manifest_from_rows(spark, rows)


RESULT_SCHEMA = T.StructType([
    T.StructField("run_id", T.IntegerType()),
    T.StructField("run_key", T.StringType()),
    T.StructField("app_name", T.StringType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("feature_set", T.StringType()),
    T.StructField("label_set", T.StringType()),
    T.StructField("split_set", T.StringType()),
    T.StructField("params", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("n_train", T.LongType()),
    T.StructField("n_test", T.LongType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("test_error", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("r2", T.DoubleType()),
    T.StructField("train_rmse", T.DoubleType()),
    T.StructField("train_r2", T.DoubleType()),
    T.StructField("iterations", T.IntegerType()),
    T.StructField("grid", T.ArrayType(T.StructType([
        T.StructField("grid_id", T.IntegerType()), T.StructField("params", T.StringType()),
        T.StructField("avg_metric", T.DoubleType()), T.StructField("best", T.BooleanType())]))),
    T.StructField("duration_s", T.DoubleType()),
    T.StructField("executor_settings", T.StringType()),
    T.StructField("error", T.StringType()),
])

# Spark settings recorded with every result row (E5).
RECORDED_SETTINGS = ("spark.executor.instances", "spark.executor.cores",
                     "spark.executor.memory", "spark.cores.max")


def executor_settings(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    parts = [f"{k}={conf.get(k)}" for k in RECORDED_SETTINGS if conf.get(k, None)]
    return ";".join(parts) or f"master={spark.sparkContext.master}"


def _app_name(r) -> str:
    """Run label from manifest fields only (never from free text)."""
    return f"{r['algorithm']} {r['label_set']} {r['feature_set']} {r['split_set'] or '-'}"


def _grid(r, name: str) -> list:
    """The values of one grid parameter: the row's list, else its single value."""
    return list(r[GRID_LISTS[name]] or [r[name]])


def run_key(r) -> str:
    """What a run computes, apart from its number: a hash of the resolved row."""
    values = {k: v for k, v in r.asDict(recursive=True).items() if k not in ("run_id", "status")}
    return hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest()


def _params_text(r) -> str:
    keys = {"logreg": ("max_iter", "reg_param", "elastic_net"),
            "logreg_cv": ("max_iter", "reg_param", "elastic_net", "num_folds"),
            "forest": ("num_trees", "max_depth", "feature_subset_strategy", "impurity"),
            "forest_cv": ("num_trees", "max_depth", "max_bins", "feature_subset_strategy",
                          "impurity", "num_folds"),
            "year": ("max_iter", "reg_param", "elastic_net", "train_split")}[r["algorithm"]]
    return ",".join(f"{k}={r[GRID_LISTS[k]] if r[GRID_LISTS[k]] else r[k]}"
                    if k in GRID_LISTS and r["algorithm"] in GRID_REQUIRED else f"{k}={r[k]}"
                    for k in keys)


def _read_once(parsed: dict, reader, spark, path):
    """Each input file is parsed and staged once per sweep, however many
    experiments combine it (13 feature sets x 3 label sets x 6 partitions
    would otherwise parse every feature file 18 times)."""
    key = (reader.__name__, path)
    if key not in parsed:
        parsed[key] = reader(spark, path)
    return parsed[key]


def _inputs(spark, sf_dir, r, parsed: dict | None = None):
    """Fixture tables by set name when ``sf_dir`` is given, else the manifest's
    files (features CSV, labels TSV or year CSV, splits TSV)."""
    if sf_dir is None:
        parsed = {} if parsed is None else parsed
        out = {"features": _read_once(parsed, files.read_features_csv, spark,
                                      r["features_path"])}
        if r["algorithm"] == "year":
            out["labels"] = _read_once(parsed, files.read_year_labels_csv, spark,
                                       r["labels_path"])
        else:
            out["labels"] = _read_once(parsed, files.read_labels_tsv, spark, r["labels_path"])
            out["splits"] = _read_once(parsed, files.read_splits_tsv, spark, r["splits_path"])
        return out
    out = {"features": fixtures.FEATURE_SETS[r["feature_set"]](spark, sf_dir),
           "labels": fixtures.LABEL_SETS[r["label_set"]](spark, sf_dir)}
    if r["split_set"]:
        out["splits"] = fixtures.SPLIT_SETS[r["split_set"]](spark, sf_dir)
    return out


def _input_key(sf_dir, r):
    """Runs with the same key share one prepared input."""
    if r["algorithm"] == "year":
        return ("year", r["features_path"], r["labels_path"], r["feature_set"], r["label_set"])
    if sf_dir is None:
        return ("genre", r["features_path"], r["labels_path"], r["splits_path"])
    return ("genre", r["feature_set"], r["label_set"], r["split_set"])


class _Features:
    """The packed, staged features of one feature set: groups are ordered by it,
    so the table of the set before is released when another one comes."""

    def __init__(self):
        self.key, self.packed = None, None

    def get(self, key, features: DataFrame) -> tuple[DataFrame, list[str]]:
        if self.packed is None or self.key != key:
            self.release()
            self.key, self.packed = key, jobs.stage_features(features, "sweep")
        return self.packed

    def release(self) -> None:
        if self.packed is not None:
            release(self.packed[0])
        self.packed = None


def _prepare_group(spark, sf_dir, r, parsed: dict, slot: str, features: _Features):
    """Driver-side, once per input group: the staged input and, for genre runs,
    its counts and category indexer (one slot per sweep, overwritten by the next
    genre group: runs are ordered by input, so the previous group is finished)."""
    inputs = _inputs(spark, sf_dir, r, parsed)
    packed = features.get(r["features_path"] if sf_dir is None else r["feature_set"],
                          inputs["features"])
    if r["algorithm"] == "year":
        return jobs.prepare_year(inputs["labels"], inputs["features"], name="sweep_year",
                                 packed=packed), None
    prepared = jobs.prepare_genre(inputs, name="sweep", path=slot, packed=packed)
    return prepared, jobs.measure_genre(prepared[0])


def _run_one(r, prepared, measured):
    algo = r["algorithm"]
    if algo == "year":
        run = jobs.run_year(None, None, r["max_iter"], r["reg_param"], r["elastic_net"],
                            r["train_split"], prepared=prepared)
        m, t = run.test_metrics().first(), run.training_metrics().first()
        return {"n_train": None, "n_test": m["n_rows"], "rmse": m["rmse"], "r2": m["r2"],
                "train_rmse": t["rmse"], "train_r2": t["r2"],
                "iterations": t["total_iterations"]}
    if algo == "logreg":
        est = models.logistic_regression(r["max_iter"], r["reg_param"], r["elastic_net"])
        run = jobs.run_genre(None, est, prepared=prepared, measured=measured)
    elif algo == "forest":
        est = models.random_forest(r["num_trees"], r["max_depth"], r["feature_subset_strategy"],
                                   r["impurity"], max_bins=r["max_bins"])
        run = jobs.run_genre(None, est, prepared=prepared, measured=measured)
    elif algo == "logreg_cv":
        run = jobs.run_genre_logreg_cv(None, _grid(r, "max_iter"), _grid(r, "reg_param"),
                                       _grid(r, "elastic_net"), num_folds=r["num_folds"],
                                       prepared=prepared, measured=measured)
    else:
        run = jobs.run_genre_forest_cv(None, _grid(r, "num_trees"), _grid(r, "max_depth"),
                                       _grid(r, "max_bins"), _grid(r, "impurity"),
                                       _grid(r, "feature_subset_strategy"),
                                       num_folds=r["num_folds"], prepared=prepared,
                                       measured=measured)
    a = run.accuracy().first()
    out = {"n_train": a["n_train"], "n_test": a["n_test"], "accuracy": a["accuracy"],
           "test_error": a["test_error"]}
    if algo in GRID_REQUIRED:
        best = tuning.best_params(run.cv_results).first().grid_id
        fixed = ("grid_id", "avg_metric", "std_metric")
        out["grid"] = [(p["grid_id"], json.dumps({k: v for k, v in p.items() if k not in fixed}),
                        p["avg_metric"], p["grid_id"] == best)
                       for p in (g.asDict() for g in run.cv_results.orderBy("grid_id").collect())]
    return out


def _error_text(exc: Exception) -> str:
    return "".join(traceback.format_exception_only(type(exc), exc)).strip()


def _execute(r, prepared, measured, base: dict) -> dict:
    start = time.perf_counter()
    try:
        base.update(_run_one(r, prepared, measured))
        base["status"] = "done"
    except Exception as exc:  # one bad experiment must not stop the sweep
        base["status"] = "failed"
        base["error"] = _error_text(exc)
    base["duration_s"] = time.perf_counter() - start
    return base


def _recorded(spark: SparkSession, results_path: str | None, keys: list[str]) -> dict:
    """Finished rows of the results table by run key, for the runs asked for."""
    if not results_path:
        return {}
    done = results.read(spark, results_path, RESULT_SCHEMA, keys).where(F.col("status") == "done")
    return {r.run_key: r.asDict(recursive=True) for r in done.drop("n_attempts").collect()}


def _check_ids(rows: list) -> None:
    """Every run needs an id of its own."""
    ids = Counter(r["run_id"] for r in rows)
    bad = sorted(str(i) for i, n in ids.items() if i is None or n > 1)
    if bad:
        raise ValueError(f"run_id must be given and unique; bad: {', '.join(bad)}")


def _to_frame(spark: SparkSession, out: list[dict]) -> DataFrame:
    names = [f.name for f in RESULT_SCHEMA.fields]
    return spark.createDataFrame([tuple(o.get(n) for n in names) for o in out], RESULT_SCHEMA)


def run_sweep(spark: SparkSession, manifest: DataFrame, sf_dir: str | None = None,
              results_path: str | None = None, parallelism: int = 2) -> DataFrame:
    """E3 + E6 + S8: run every ready manifest row; one result row per run.

    Inputs are the fixture tables of ``sf_dir`` named by the set columns, or,
    without ``sf_dir``, the files named by the path columns; each file is
    parsed once per sweep.  Runs are grouped by input: a feature set is packed
    and staged once for all its groups, a group's joined input is staged,
    counted and indexed once, then up to ``parallelism`` of its runs train at the same
    time (driver threads submitting distributed jobs; one small experiment
    alone leaves most of a large cluster idle).
    A failing run records its error and the sweep goes on.  With
    ``results_path`` each row is committed to a Parquet results table as soon
    as its run ends (:mod:`trackml.plans.results`; read it with
    :func:`read_results`).  A run recorded there as done under the same
    ``run_key`` (all resolved settings, not the number) is not run again, so a
    sweep interrupted by a driver failure resumes where it stopped, and sweeps
    at the same time leave one row per run.  The result has a row for every
    manifest row, also after a resume.  Missing or repeated ``run_id`` values
    are refused before anything runs.
    """
    rows = apply_defaults(manifest).orderBy(
        F.col("features_path").asc_nulls_first(), F.col("labels_path").asc_nulls_first(),
        F.col("splits_path").asc_nulls_first(), F.col("feature_set").asc_nulls_first(),
        F.col("label_set").asc_nulls_first(), F.col("split_set").asc_nulls_first(),
        "run_id").collect()
    _check_ids(rows)
    settings = executor_settings(spark)
    finished = _recorded(spark, results_path, [run_key(r) for r in rows])
    slot = stage_path(spark, "sweep")
    parsed: dict = {}
    features = _Features()
    out = []

    attempt = results.new_attempt()

    def record(base):
        out.append(base)
        if results_path:
            results.commit(_to_frame(spark, [base]), results_path, attempt)

    todo = [r for r in rows if run_key(r) not in finished]
    out.extend(dict(finished[run_key(r)], run_id=r["run_id"]) for r in rows
               if run_key(r) in finished)
    last_staged = None
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        for _, group in itertools.groupby(todo, key=lambda r: _input_key(sf_dir, r)):
            group = list(group)
            bases = {r["run_id"]: {"run_id": r["run_id"], "run_key": run_key(r),
                                   "app_name": _app_name(r),
                                   "algorithm": r["algorithm"], "feature_set": r["feature_set"],
                                   "label_set": r["label_set"], "split_set": r["split_set"],
                                   "params": _params_text(r), "status": r["status"],
                                   "executor_settings": settings} for r in group}
            ready = [r for r in group if r["status"] == "ready"]
            for r in group:
                if r["status"] != "ready":
                    record(bases[r["run_id"]])
            if not ready:
                continue
            try:
                prepared, measured = _prepare_group(spark, sf_dir, ready[0], parsed, slot, features)
            except Exception as exc:
                for r in ready:
                    record(dict(bases[r["run_id"]], status="failed", error=_error_text(exc)))
                continue
            futures = [pool.submit(inheritable_thread_target(spark)(_execute), r, prepared, measured,
                                   bases[r["run_id"]]) for r in ready]
            for fut in as_completed(futures):
                record(fut.result())
            if ready[0]["algorithm"] == "year":
                release(prepared[0])
            else:
                last_staged = prepared[0]
    features.release()
    # the sweep's own staged tables: the last joined input and the parsed files
    for staged in ([last_staged] if last_staged is not None else []) + list(parsed.values()):
        release(staged)
    return _to_frame(spark, sorted(out, key=lambda o: o["run_id"]))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The results table, one row per run, with its number of attempts."""
    return results.read(spark, path, RESULT_SCHEMA)


def summarize(rows: DataFrame) -> DataFrame:
    """E7 (extension): runs, mean accuracy / error, mean duration per
    (label set, feature set, algorithm)."""
    done = rows.where(F.col("status") == "done")
    return done.groupBy("label_set", "feature_set", "algorithm").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.round(F.avg("accuracy"), 8).alias("avg_accuracy"),
        F.round(F.avg("test_error"), 8).alias("avg_test_error"),
        F.round(F.avg("rmse"), 6).alias("avg_rmse"),
        F.round(F.avg("duration_s"), 3).alias("avg_duration_s"))
