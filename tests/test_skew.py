"""Hot tracks in the track joins: same rows, spread over the tasks."""

import contextlib
import io
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trackml.operators import prepare, skew
from trackml.sources import fixtures

from conftest import SF_SMALL

N = 6000


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def _inputs(spark, tmp_dir, hot_side):
    """Track 7 has half as many rows as all others together: a third of its side."""
    key = F.col("id").alias("track_id")
    hot = spark.range(N // 2).select(F.lit(7).cast("long").alias("track_id"))
    splits = spark.range(N).select(key, F.lit("TRAIN").alias("subset"))
    labels = spark.range(N).select(key, F.col("id").cast("string").alias("label"))
    if hot_side == "labels":
        labels = labels.unionByName(hot.withColumn("label", F.lit("same")))
    else:
        splits = splits.unionByName(hot.withColumn("subset", F.lit("TEST")))
    nulls = spark.createDataFrame([(None, "x")] * 500, "track_id long, label string")
    feats = spark.range(N).select(key, F.col("id").cast("double").alias("a"))
    out = []
    for i, df in enumerate((splits, labels.unionByName(nulls), feats)):
        df.write.parquet(f"{tmp_dir}/{i}")
        out.append(spark.read.parquet(f"{tmp_dir}/{i}"))
    return out


@pytest.mark.parametrize("hot_side", ["labels", "splits"])
def test_hot_track_is_dealt(spark, tmp_dir, hot_side):
    splits, labels, feats = _inputs(spark, tmp_dir, hot_side)
    found = skew.hot_keys([splits, labels], "track_id", 0.01, 50)
    assert [(h.key, h.side) for h in found] == [(7, int(hot_side == "labels"))]
    assert 25 <= found[0].parts <= 100

    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",
                                          "spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.forceOptimizeSkewedJoin")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "false")
    try:
        joined = prepare.join_tracks(splits, labels, feats, share=0.01, min_rows=50)
        plan = _plan(joined)
        # both joins on key and part in one stage; only the hot keys are broadcast
        assert plan.count("SortMergeJoin") == 2 and plan.count("_part#") > 4
        assert plan.count("Exchange hashpartitioning(track_id") == 3
        assert "_hot_key" in plan and "skew=true" not in plan
        rows = joined.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert joined.columns == ["track_id", "subset", "label", "a"]
    plain = splits.join(labels, "track_id").join(feats, "track_id")
    assert Counter(tuple(r)[:4] for r in rows) == Counter(map(tuple, plain.collect()))
    sizes = sorted(Counter(r.task for r in rows).values())
    assert len(sizes) == 8 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert sizes[-1] < 0.25 * len(rows)


def test_hot_on_both_sides(spark):
    a = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 0)], "track_id long, x int")
    b = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 1)], "track_id long, y int")
    out = skew.join_on_key([a, b], "track_id", [0, 1], share=0.1, min_rows=2)
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, a.join(b, "track_id").collect()))


def test_string_keys(spark):
    a = spark.createDataFrame([("h'ot", i) for i in range(40)] + [("c", 0), (None, 1)],
                              "track_id string, x int")
    b = spark.createDataFrame([("h'ot", 1.0), ("c", 2.0), (None, 3.0)], "track_id string, y double")
    out = prepare.join_year(a, b, share=0.1, min_rows=2)
    assert out.count() == 41 and out.columns == ["track_id", "x", "y"]


def test_without_hot_track_the_plan_is_plain(spark):
    i = fixtures.order_inputs(spark, SF_SMALL)
    joined = prepare.join_tracks(i["splits"], i["labels"], i["features"])
    assert skew.PART not in _plan(joined)
    empty = i["labels"].limit(0)
    assert skew.hot_keys([empty], "track_id") == []


def test_share_is_bounded(spark):
    with pytest.raises(ValueError):
        skew.hot_keys([spark.range(3)], "id", share=1e-6)
