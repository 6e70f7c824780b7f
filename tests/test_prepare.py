"""Joins, feature columns, splits and folds."""

from pyspark.sql import functions as F

import pytest

from trackml.operators import prepare
from trackml.sources import fixtures

from conftest import SF_SMALL


def test_fixture_join_counts(spark):
    i = fixtures.order_inputs(spark, SF_SMALL)
    j = prepare.join_tracks(i["splits"], i["labels"], i["features"])
    assert j.count() == 1473
    counts = {r.subset: r.n for r in j.groupBy("subset").agg(F.count("*").alias("n")).collect()}
    assert counts == {"TRAIN": 1181, "TEST": 292}
    assert prepare.feature_columns(j) == fixtures.ORDER_FEATURES


def test_null_keys_never_match(spark):
    a = spark.createDataFrame([(1, "TRAIN"), (None, "TEST")], "track_id long, subset string")
    b = spark.createDataFrame([(1, "x"), (None, "y")], "track_id long, label string")
    c = spark.createDataFrame([(1, 1.0), (None, 2.0)], "track_id long, v double")
    assert prepare.join_tracks(a, b, c).count() == 1


def test_arrays_of_different_length_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "track_id long, v array<double>")
    with pytest.raises(ValueError):
        prepare.pack_features(df)
    packed, names = prepare.pack_features(df.limit(1))
    assert names == ["v_0", "v_1"]
    with pytest.raises(Exception, match="named feature values"):
        prepare.vectorize(packed, names[:1]).collect()


def test_key_split_deterministic_and_whole(spark):
    df = spark.range(1000).withColumnRenamed("id", "track_id")
    s1 = prepare.key_split(df, 0.7)
    s2 = prepare.key_split(df, 0.7)
    assert s1.count() == 1000
    assert s1.where("subset = 'TRAIN'").count() == 700
    assert s1.exceptAll(s2).count() == 0


def test_key_split_string_keys(spark):
    df = spark.createDataFrame([(f"TR{i:05d}",) for i in range(2000)], "track_id string")
    n = prepare.key_split(df, 0.5).where("subset = 'TRAIN'").count()
    assert 800 < n < 1200


def test_folds_in_range(spark):
    df = spark.range(100).withColumnRenamed("id", "track_id")
    folds = {r.fold for r in prepare.assign_folds(df, 3).select("fold").distinct().collect()}
    assert folds == {0, 1, 2}


def test_random_split_seeded(spark):
    df = spark.range(500).withColumnRenamed("id", "track_id")
    a, _ = prepare.random_split(df, 0.7, seed=7)
    b, _ = prepare.random_split(df, 0.7, seed=7)
    assert sorted(r.track_id for r in a.collect()) == sorted(r.track_id for r in b.collect())


def test_array_features_assemble(spark):
    e = fixtures.embedding_features(spark, SF_SMALL)
    out = prepare.assemble(e, ["embedding"])
    assert out.first().features.size == 64


def test_hot_key_and_hot_label(spark):
    """One track holds a third of all label rows and one label most rows: the
    join multiplies that track's rows (inner-join semantics), counts stay exact."""
    from trackml.plans import jobs

    n = 3000
    splits = spark.range(n).select(F.col("id").alias("track_id"),
                                   F.when(F.col("id") % 10 < 8, "TRAIN").otherwise("TEST")
                                   .alias("subset"))
    normal = spark.range(n).select(F.col("id").alias("track_id"),
                                   F.when(F.col("id") % 3 == 0, "rare").otherwise("hot")
                                   .alias("label"))
    hot = spark.range(n // 2).select(F.lit(7).cast("long").alias("track_id"),
                                     F.lit("hot").alias("label"))
    labels = normal.unionByName(hot)          # track 7: 1 + 1500 of 4500 rows
    feats = spark.range(n).select(F.col("id").alias("track_id"),
                                  (F.col("id") % 5).cast("double").alias("a"),
                                  (F.col("id") * 0.5).cast("double").alias("b"))
    joined = prepare.join_tracks(splits, labels, feats)
    assert joined.count() == n + n // 2
    assert joined.where("track_id = 7").count() == 1 + n // 2
    run = jobs.run_genre_logreg({"splits": splits, "labels": labels, "features": feats})
    assert run.n_train + run.n_test == n + n // 2
    assert run.label_model.labels == ["hot", "rare"]
    assert run.predictions.count() == run.n_test
    # two classes → binomial model (Spark's "auto" family); report names class 1
    from trackml.operators import models
    lr = models.estimator_stage(run.model)
    rows = models.coefficient_rows(spark, lr, run.label_model.labels, run.feature_names)
    assert {r.label for r in rows.collect()} == {"rare"}


def test_partition_sizing():
    from trackml.session import partitions_for

    assert partitions_for(10 * 1024 ** 2) == 200
    assert partitions_for(100 * 1024 ** 4) == 819200
