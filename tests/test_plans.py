"""Physical-plan properties the scale design relies on (read from explain())."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from trackml.operators import prepare
from trackml.plans import jobs
from trackml.sources import fixtures

from conftest import SF_SMALL


def _plan(df, mode: str = "simple") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.fixture()
def no_planner_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_each_input_shuffled_once(spark, no_planner_broadcast):
    inp = fixtures.order_inputs(spark, SF_SMALL)
    packed, names = prepare.pack_features(inp["features"])
    joined = prepare.vectorize(prepare.join_tracks(inp["splits"], inp["labels"], packed), names)
    plan = _plan(joined)
    assert plan.count("Exchange hashpartitioning") == 3      # splits, labels, lineitem
    assert "BroadcastExchange" not in plan
    assert plan.count("SortMergeJoin") == 2
    # the feature side is packed below the join: the aggregate emits the array
    formatted = _plan(joined, "formatted")
    results = [line for line in formatted.splitlines()
               if line.startswith("Results") and "AS feature_values" in line]
    assert len(results) == 1 and "AS track_id" in results[0]


def test_scans_read_only_used_columns(spark):
    plan = _plan(fixtures.order_features(spark, SF_SMALL))
    schema = [line for line in plan.splitlines() if "lineitem.parquet" in line][0]
    for col in ("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"):
        assert col in schema
    for col in ("l_partkey", "l_suppkey", "l_tax", "l_discount", "l_shipdate"):
        assert col not in schema


def test_staged_filters_reach_the_scan(spark):
    staged, _ = jobs.prepare_genre(fixtures.order_inputs(spark, SF_SMALL), num_folds=3)
    plan = _plan(prepare.subset_rows(staged, prepare.TRAIN).where(F.col("fold") != 1))
    assert "PartitionFilters: [isnotnull(subset" in plan and "(subset#" in plan
    assert "PushedFilters: [IsNotNull(fold), Not(EqualTo(fold,1))]" in plan


SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def test_hot_track_partition_is_split(spark):
    """A track with two thirds of the label rows: with the session default
    forceOptimizeSkewedJoin, AQE splits its partition in the chained joins
    (sizes lowered here so that a small input counts as skewed)."""
    from trackml.session import DEFAULT_CONF

    assert DEFAULT_CONF["spark.sql.adaptive.forceOptimizeSkewedJoin"] == "true"
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        n = 20000
        splits = spark.range(n).select(F.col("id").alias("track_id"),
                                       F.lit("TRAIN").alias("subset"))
        normal = spark.range(n).select(F.col("id").alias("track_id"), F.lit("x").alias("label"))
        hot = spark.range(2 * n).select(F.lit(7).cast("long").alias("track_id"),
                                        F.sha2(F.col("id").cast("string"), 256).alias("label"))
        feats = spark.range(n).select(F.col("id").alias("track_id"),
                                      F.col("id").cast("double").alias("a"))
        joined = prepare.join_tracks(splits, normal.unionByName(hot), feats)
        assert len(joined.collect()) == 3 * n
        plan = _plan(joined)
        assert "isFinalPlan=true" in plan
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_staged_tables_live_in_the_checkpoint_folder(spark):
    from trackml.session import checkpoint_root, stage

    root = checkpoint_root(spark)
    assert root == spark.sparkContext.getCheckpointDir()
    staged = stage(spark.range(10).withColumnRenamed("id", "track_id"), "probe")
    files = staged.inputFiles()
    bare = root.replace("file://", "").replace("file:", "")
    assert files and all(bare in f for f in files)
    assert staged.count() == 10
