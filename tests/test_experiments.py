"""Manifest, defaults, readiness, sweep."""

import pytest

from trackml.plans import experiments, results

from conftest import SF_SMALL


def test_manifest_product(spark):
    m = experiments.build_manifest(spark, {"a": "/x/a.csv", "b": "/x/b.csv"},
                                   {"g": "/x/g.cls"}, {"p5": "/x/p5.cls", "p6": "/x/p6.cls"},
                                   ["logreg", "forest"], {"num_trees": 10})
    assert m.count() == 2 * 1 * 2 * 2


def test_unknown_param_rejected(spark):
    with pytest.raises(ValueError):
        experiments.build_manifest(spark, {"a": "p"}, {"g": "p"}, {"s": "p"}, ["forest"],
                                   {"numFold": 3})


def test_defaults_and_rejections(spark):
    m = experiments.manifest_from_rows(spark, [
        {"run_id": 0, "algorithm": "logreg", "splits_path": "s"},
        {"run_id": 1, "algorithm": "forest", "splits_path": "s"},
        {"run_id": 2, "algorithm": "forest", "splits_path": "s", "num_trees": 7},
        {"run_id": 3, "algorithm": "year"},
        {"run_id": 4, "algorithm": "logreg", "reg_param": 0.01},
        {"run_id": 5, "algorithm": "logreg_cv", "splits_path": "s", "max_iter": 10,
         "reg_param": 0.3},
        {"run_id": 6, "algorithm": "forest_cv", "splits_path": "s", "num_trees": 5,
         "max_depth": 4, "max_bins": 16, "impurity": "gini",
         "feature_subset_strategy": "auto"},
    ])
    rows = {r.run_id: r for r in experiments.apply_defaults(m).collect()}
    assert (rows[0].max_iter, rows[0].reg_param, rows[0].elastic_net) == (10, 0.3, 0.8)
    assert rows[0].status == "ready"
    assert rows[1].status.startswith("rejected")
    assert rows[2].status == "ready" and rows[2].max_depth == 5 and rows[2].impurity == "gini"
    assert rows[3].status == "ready" and rows[3].train_split == 0.7
    assert rows[4].status.startswith("rejected")
    assert rows[5].status == "rejected: grid list elastic_net missing"
    assert rows[6].status == "ready" and rows[6].num_folds == 10


def test_readiness(spark):
    m = experiments.manifest_from_rows(spark, [
        {"run_id": 0, "algorithm": "logreg", "features_path": f"{SF_SMALL}/lineitem.parquet",
         "labels_path": f"{SF_SMALL}/orders.parquet", "splits_path": f"{SF_SMALL}/nope.parquet"},
        {"run_id": 1, "algorithm": "year", "features_path": SF_SMALL,
         "labels_path": f"{SF_SMALL}/orders.parquet"},
    ])
    got = {(r.run_id, r.role): r.status
           for r in experiments.readiness(spark, m, [SF_SMALL]).collect()}
    assert got == {(0, "features"): "CHECK", (0, "labels"): "CHECK",
                   (0, "splits"): "MISSING", (1, "features"): "CHECK",
                   (1, "labels"): "CHECK"}


def test_sweep_records_failures_and_results(spark, tmp_dir):
    m = experiments.manifest_from_rows(spark, [
        {"run_id": 0, "algorithm": "logreg", "feature_set": "orders", "label_set": "orders",
         "split_set": "orders", "splits_path": "x"},
        {"run_id": 1, "algorithm": "forest", "feature_set": "orders", "label_set": "orders",
         "split_set": "orders", "splits_path": "x"},
        {"run_id": 2, "algorithm": "forest", "feature_set": "orders", "label_set": "orders",
         "split_set": "orders", "splits_path": "x", "num_trees": 3, "impurity": "variance"},
    ])
    path = f"{tmp_dir}/results"
    res = {r.run_id: r for r in experiments.run_sweep(spark, m, SF_SMALL, path).collect()}
    assert res[0].status == "done" and round(res[0].accuracy, 6) == 0.184932
    assert res[1].status.startswith("rejected")
    assert res[2].status == "failed" and "variance" in res[2].error
    assert spark.read.parquet(path).count() == 3
    summary = experiments.summarize(spark.read.parquet(path)).collect()
    assert len(summary) == 1 and summary[0].n_runs == 1
    # a second sweep over the same results table does not run the finished run
    # again, and still returns a row for every manifest row
    again = {r.run_id: r for r in experiments.run_sweep(spark, m, SF_SMALL, path).collect()}
    assert sorted(again) == [0, 1, 2] and again[0] == res[0]
    assert spark.read.parquet(path).where("run_id = 0").count() == 1


def test_resume_is_keyed_on_what_a_run_computes(spark, tmp_dir):
    base = {"feature_set": "orders", "label_set": "orders", "split_set": "orders",
            "splits_path": "x", "run_id": 0}
    path = f"{tmp_dir}/results"
    one = experiments.manifest_from_rows(spark, [dict(base, algorithm="logreg")])
    other = experiments.manifest_from_rows(spark, [dict(base, algorithm="forest", num_trees=2)])
    renumbered = experiments.manifest_from_rows(
        spark, [dict(base, algorithm="logreg", run_id=7)])
    first = experiments.run_sweep(spark, one, SF_SMALL, path).first()
    second = experiments.run_sweep(spark, other, SF_SMALL, path).first()
    third = experiments.run_sweep(spark, renumbered, SF_SMALL, path).first()
    assert (first.algorithm, second.algorithm) == ("logreg", "forest")
    assert (third.run_id, third.accuracy) == (7, first.accuracy)
    assert spark.read.parquet(path).count() == 2


@pytest.mark.parametrize("ids", [(1, 1), (None,), (0, None)])
def test_missing_and_repeated_ids_are_refused(spark, tmp_dir, ids):
    m = experiments.manifest_from_rows(
        spark, [{"run_id": i, "algorithm": "logreg"} for i in ids])
    with pytest.raises(ValueError, match="run_id"):
        experiments.run_sweep(spark, m, SF_SMALL, f"{tmp_dir}/results")


def test_check_keeps_every_row(spark, tmp_dir):
    from trackml.__main__ import main

    path = f"{tmp_dir}/runs.csv"
    with open(path, "w") as fh:
        fh.write("run_id,algorithm,features_path\n")
        fh.writelines(f"{i},year,{SF_SMALL}/f{i}.csv\n" for i in range(1100))
    out = f"{tmp_dir}/ready"
    assert main(["check", "--manifest", path, "--roots", SF_SMALL, "--out", out]) == 0
    assert spark.read.parquet(out).where("status = 'MISSING'").count() == 1100


def test_sweep_over_text_files(spark, tmp_dir):
    from trackml.sources import files, fixtures
    inp = fixtures.order_inputs(spark, SF_SMALL)
    inp["features"].withColumnRenamed("track_id", files.SOURCE_KEY) \
        .write.option("header", True).csv(f"{tmp_dir}/features")
    inp["labels"].write.option("sep", "\t").csv(f"{tmp_dir}/labels")
    inp["labels"].write.option("sep", "\t").csv(f"{tmp_dir}/labels2")
    inp["splits"].write.option("sep", "\t").csv(f"{tmp_dir}/splits")
    m = experiments.build_manifest(spark, {"orders": f"{tmp_dir}/features"},
                                   {"priority": f"{tmp_dir}/labels",
                                    "copy": f"{tmp_dir}/labels2"},
                                   {"key80": f"{tmp_dir}/splits"}, ["logreg", "forest"],
                                   {"num_trees": 5})
    calls = []
    real = files.read_features_csv

    def counting(spark_, path):
        calls.append(path)
        return real(spark_, path)

    files.read_features_csv = counting
    try:
        rows = experiments.run_sweep(spark, m).collect()
        res = {r.algorithm: r for r in rows if r.label_set == "priority"}
    finally:
        files.read_features_csv = real
    assert res["logreg"].status == "done" and round(res["logreg"].accuracy, 6) == 0.184932
    assert res["forest"].status == "done" and res["forest"].n_test == 292
    assert len(rows) == 4 and all(r.status == "done" for r in rows)
    assert len(calls) == 1   # one parse of the features file for both label sets


def test_readiness_missing_root(spark, tmp_dir):
    m = experiments.manifest_from_rows(spark, [
        {"run_id": 0, "algorithm": "year", "features_path": f"{tmp_dir}/gone/f.csv",
         "labels_path": f"{SF_SMALL}/orders.parquet"}])
    got = {r.role: r.status for r in
           experiments.readiness(spark, m, [f"{tmp_dir}/gone", SF_SMALL]).collect()}
    assert got == {"features": "MISSING", "labels": "CHECK"}


def test_readiness_uri_forms(spark):
    m = experiments.manifest_from_rows(spark, [
        {"run_id": 0, "algorithm": "year", "features_path": f"file://{SF_SMALL}/lineitem.parquet",
         "labels_path": f"{SF_SMALL}/orders.parquet/"}])
    got = {r.role: r.status for r in experiments.readiness(spark, m, [SF_SMALL]).collect()}
    assert got == {"features": "CHECK", "labels": "CHECK"}


def test_manifest_csv_and_cli(spark, tmp_dir):
    from trackml.__main__ import main, read_manifest

    path = f"{tmp_dir}/runs.csv"
    with open(path, "w") as fh:
        fh.write("run_id,algorithm,feature_set,label_set,split_set,features_path,"
                 "labels_path,splits_path,num_trees\n")
        fh.write(f"0,logreg,orders,orders,orders,{SF_SMALL}/lineitem.parquet,"
                 f"{SF_SMALL}/orders.parquet,{SF_SMALL}/orders.parquet,\n")
        fh.write(f"1,forest,orders,orders,orders,{SF_SMALL}/lineitem.parquet,"
                 f"{SF_SMALL}/orders.parquet,{SF_SMALL}/missing.parquet,3\n")
    m = read_manifest(spark, path)
    assert m.schema == experiments.MANIFEST_SCHEMA
    assert [r.num_trees for r in m.orderBy("run_id").collect()] == [None, 3]
    assert main(["check", "--manifest", path, "--roots", SF_SMALL,
                 "--out", f"{tmp_dir}/ready"]) == 0
    results = f"{tmp_dir}/results"
    assert main(["sweep", "--manifest", path, "--fixtures", SF_SMALL,
                 "--results", results]) == 0
    done = spark.read.parquet(results).where("status = 'done'").count()
    assert done == 2


def test_sweep_runs_grid_search_rows(spark):
    base = {"feature_set": "orders", "label_set": "orders", "split_set": "orders",
            "splits_path": "x", "num_folds": 3}
    m = experiments.manifest_from_rows(spark, [
        dict(base, run_id=0, algorithm="logreg_cv", max_iter=10, reg_param=0.3,
             elastic_net=0.8),
        dict(base, run_id=1, algorithm="forest_cv", num_trees=3, max_depth=3, max_bins=16,
             impurity="gini", feature_subset_strategy="auto"),
    ])
    res = {r.run_id: r for r in experiments.run_sweep(spark, m, SF_SMALL).collect()}
    assert res[0].status == "done" and round(res[0].accuracy, 6) == 0.184932
    assert res[1].status == "done" and res[1].n_test == 292


def test_grid_lists_give_every_point_and_a_best_one(spark):
    m = experiments.manifest_from_rows(spark, [
        {"feature_set": "orders", "label_set": "orders", "split_set": "orders",
         "splits_path": "x", "num_folds": 3, "run_id": 0, "algorithm": "logreg_cv",
         "max_iter": 5, "reg_params": [0.3, 0.1], "elastic_nets": [0.0, 1.0]}])
    [row] = experiments.run_sweep(spark, m, SF_SMALL).collect()
    assert row.status == "done" and [g.grid_id for g in row.grid] == [0, 1, 2, 3]
    assert sum(g.best for g in row.grid) == 1 and len({g.params for g in row.grid}) == 4


def test_listed_and_manifest_uris_compare_by_path(spark):
    uris = ["hdfs:///t/a.csv", "hdfs://nn:8020/t/a.csv", "file:/t/a.csv", "/t/a.csv/"]
    df = spark.createDataFrame([(u,) for u in uris], "u string")
    assert {r[0] for r in df.select(experiments._strip_scheme(df.u)).collect()} == {"/t/a.csv"}


def test_sweep_shares_features_counts_and_indexers(spark, tmp_dir, monkeypatch):
    """A feature set is packed and staged once for genre and year groups; a group's
    counts and category indexer are taken once for all its runs."""
    from trackml.operators import indexing, prepare
    from trackml.plans import jobs

    calls = []

    def counting(module, name):
        real = getattr(module, name)

        def call(*args, **kw):
            calls.append(name)
            return real(*args, **kw)
        monkeypatch.setattr(module, name, call)

    counting(prepare, "pack_features")
    counting(jobs, "subset_label_counts")
    counting(indexing, "fit_feature_indexer")
    base = {"feature_set": "orders", "features_path": "f", "labels_path": "x"}
    genre = dict(base, label_set="orders", split_set="orders", splits_path="x")
    year = dict(base, label_set="orders_year", algorithm="year")
    m = experiments.manifest_from_rows(spark, [
        dict(genre, run_id=0, algorithm="logreg"),
        dict(genre, run_id=1, algorithm="forest", num_trees=2),
        dict(year, run_id=2), dict(year, run_id=3, reg_param=0.01)])
    rows = {r.run_id: r for r in experiments.run_sweep(spark, m, SF_SMALL).collect()}
    assert [rows[i].status for i in range(4)] == ["done"] * 4, [r.error for r in rows.values()]
    assert round(rows[0].accuracy, 6) == 0.184932 and rows[2].n_test == rows[3].n_test > 0
    assert sorted(calls) == ["fit_feature_indexer", "pack_features", "subset_label_counts"]


# ---------------------------------------------------------------- results table

def _two_runs(spark):
    base = {"feature_set": "orders", "label_set": "orders", "split_set": "orders",
            "features_path": "x", "labels_path": "x", "splits_path": "x"}
    return experiments.manifest_from_rows(spark, [
        dict(base, run_id=0, algorithm="logreg", max_iter=2),
        dict(base, run_id=1, algorithm="logreg", max_iter=3),
        dict(base, run_id=2, algorithm="forest")])        # no num_trees: rejected


def _table(spark, path):
    return {r.run_id: r for r in experiments.read_results(spark, path).collect()}


def test_crash_between_run_and_record_leaves_one_row(spark, tmp_dir, monkeypatch):
    path = f"{tmp_dir}/results"
    assert _table(spark, path) == {}
    real, calls = results.commit, []

    def crash(rows, path_, attempt):
        calls.append(attempt)
        if len(calls) == 3:
            raise RuntimeError("driver lost")
        real(rows, path_, attempt)

    monkeypatch.setattr(results, "commit", crash)
    with pytest.raises(RuntimeError, match="driver lost"):
        experiments.run_sweep(spark, _two_runs(spark), SF_SMALL, path)
    monkeypatch.setattr(results, "commit", real)
    assert len(_table(spark, path)) == 2
    out = experiments.run_sweep(spark, _two_runs(spark), SF_SMALL, path)
    found = _table(spark, path)
    assert out.count() == 3 and sorted(found) == [0, 1, 2]
    assert [found[i].status == "done" for i in range(3)] == [True, True, False]
    # what was recorded before the crash was not run again
    assert sorted(found[i].n_attempts for i in (0, 1)) == [1, 1]


def test_two_sweeps_at_once_leave_one_row_per_run(spark, tmp_dir):
    from concurrent.futures import ThreadPoolExecutor

    path = f"{tmp_dir}/results"
    with ThreadPoolExecutor(2) as pool:
        outs = list(pool.map(lambda _: experiments.run_sweep(
            spark, _two_runs(spark), SF_SMALL, path).count(), range(2)))
    found = experiments.read_results(spark, path)
    assert outs == [3, 3] and found.count() == 3
    assert found.where("status = 'done'").count() == 2


def test_writing_a_result_again_and_which_attempt_counts(spark, tmp_dir):
    path = f"{tmp_dir}/results"

    def row(key, status, error=None):
        return experiments._to_frame(spark, [
            {"run_id": 5, "run_key": key, "status": status, "error": error}])

    results.commit(row("k1", "done"), path, "a-1")
    results.commit(row("k1", "done"), path, "a-1")
    results.commit(row("k2", "failed", "first"), path, "a-1")
    results.commit(row("k2", "failed", "second"), path, "a-2")
    results.commit(row("k3", "done"), path, "a-1")
    results.commit(row("k3", "failed", "late"), path, "a-2")
    assert results.attempts(spark, path, experiments.RESULT_SCHEMA).count() == 5
    found = {r.run_key: (r.status, r.error, r.n_attempts)
             for r in experiments.read_results(spark, path).collect()}
    assert found == {"k1": ("done", None, 1), "k2": ("failed", "second", 2),
                     "k3": ("done", None, 2)}
