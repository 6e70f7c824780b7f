"""Benchmark the headline jobs at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Two kinds of entries:

* job entries (``genre_logreg`` ...): the whole job as a user runs it (scans,
  three-way join, assembling, staging to Parquet, indexer fits, training,
  scoring, metrics);
* ``fit_*`` entries: training + scoring + metric on an already staged input,

Each entry is the best of ``$BENCH_REPEAT`` runs (default 2), after warm-up
runs of every job on sf0.01 so JVM start-up, class loading and JIT compilation
are not counted.  Every run
re-reads and re-stages its input; nothing is cached between runs.

Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trackml.operators import models, tuning  # noqa: E402
from trackml.plans import catalog, jobs  # noqa: E402
from trackml.session import build_session  # noqa: E402
from trackml.sources import fixtures  # noqa: E402


def _best(fn, repeat: int) -> float:
    times = []
    for _ in range(repeat):
        t0 = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t0)
    return round(min(times), 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = build_session(f"local[{cpus}]", app_name="trackml-bench", shuffle_partitions=cpus,
                          conf={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")

    # warm-up: class loading and JIT for every job type, on smaller tables in
    # another directory (nothing of the timed runs is reused: every run scans
    # and stages its own input)
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    for _ in range(2):
        catalog.accuracy_test_error(spark, warm).collect()
        catalog.forest_test_error(spark, warm).collect()
        catalog.logreg_cv_test_error(spark, warm).collect()
        catalog.forest_cv(spark, warm).collect()
        catalog.year_job(spark, warm).collect()
        catalog.indexed_features(spark, warm).count()

    jobs_timed = {
        "genre_logreg": lambda: catalog.accuracy_test_error(spark, sf_dir).collect(),
        "genre_forest": lambda: catalog.forest_test_error(spark, sf_dir).collect(),
        "genre_logreg_cv": lambda: catalog.logreg_cv_test_error(spark, sf_dir).collect(),
        "genre_forest_cv": lambda: catalog.forest_cv(spark, sf_dir).collect(),
        "year_regression": lambda: catalog.year_job(spark, sf_dir).collect(),
        "embedding_logreg": lambda: catalog.embedding_logreg_accuracy(spark, sf_dir).collect(),
        "track_join": lambda: catalog.track_join(spark, sf_dir).count(),
        "indexed_features": lambda: catalog.indexed_features(spark, sf_dir).count(),
    }
    q = {name: _best(fn, repeat) for name, fn in jobs_timed.items()}

    # fit + score + metric only, on one staged input per data set (BASELINE §2)
    orders = jobs.prepare_genre(fixtures.order_inputs(spark, sf_dir), name="bench", num_folds=3)
    emb = jobs.prepare_genre(fixtures.embedding_inputs(spark, sf_dir), name="bench_emb")

    def fit(prepared, est):
        return lambda: jobs.run_genre(None, est, prepared=prepared).accuracy().collect()

    def forest_cv_fit():
        rf = models.random_forest(1)
        grid = tuning.forest_grid(rf, [10], [32], [5, 6], ["gini"], ["auto"])
        run = jobs.run_genre_cv(None, rf, grid, tuning.FOREST_GRID_PARAMS, num_folds=3,
                                prepared=orders)
        run.cv_results.collect()

    q["fit_logreg"] = _best(fit(orders, models.logistic_regression()), repeat)
    q["fit_forest"] = _best(fit(orders, models.random_forest(10)), repeat)
    q["fit_forest_cv_2x3"] = _best(forest_cv_fit, repeat)
    q["fit_embedding_logreg"] = _best(fit(emb, models.logistic_regression()), repeat)
    q["fit_embedding_logreg_light"] = _best(
        fit(emb, models.logistic_regression(10, 0.01, 0.0)), repeat)
    q["fit_embedding_forest"] = _best(fit(emb, models.random_forest(10)), repeat)

    total = round(sum(q.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_job_seconds", "value": total, "unit": "sec",
                      "queries": q, "sf": sf, "cpus": cpus, "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
