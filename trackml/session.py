"""Session settings and lineage cuts.

Everything here is plain Spark configuration: AQE decides join strategy at
runtime (a side is broadcast only when its measured shuffle output is below
``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise sort-merge),
skewed join partitions are split, and partitions are coalesced after shuffles.
A session handed in by a caller keeps its own settings.

Multi-pass work (indexer fits, iterative training, k folds) reads a frame many
times.  Instead of caching executor-local blocks, which are lost with the
executor, such frames are written once as Parquet under the cluster's shared
``spark.checkpoint.dir`` and read back (``stage``).  A lost executor then costs
a re-read of the staged files, not a re-run of scans and joins.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults for sessions built by this package.  A session handed in by a caller
# (cluster driver, test harness) is used as it is.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the track joins chain two sort-merge joins in one stage; AQE splits a
    # skewed partition there (e.g. a track holding a third of all label rows)
    # only when allowed to add the shuffle this needs above the split join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    # No broadcast from planner estimates (they can be far off for aggregates
    # and joins); AQE broadcasts a join side only after its shuffle has been
    # measured below this size, and uses sort-merge otherwise.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Target size of one shuffle partition (AQE coalesces towards it).
PARTITION_BYTES = 128 * 1024 * 1024


def partitions_for(input_bytes: int, minimum: int = 200) -> int:
    """Initial shuffle partitions so that ~``PARTITION_BYTES`` of input land in
    each (e.g. 100 TB → about 800,000); AQE then merges small ones."""
    return max(minimum, math.ceil(input_bytes / PARTITION_BYTES))


def build_session(master: str | None = None, app_name: str = "trackml",
                  shuffle_partitions: int | None = None, input_bytes: int | None = None,
                  conf: dict | None = None) -> SparkSession:
    """Create (or get) a session with the package defaults.

    ``master`` is only set when given: under ``spark-submit`` the cluster
    manager decides.  ``input_bytes`` (size of the largest input) sizes the
    shuffle so that partitions stay near 128 MB and fit executor memory;
    ``shuffle_partitions`` sets the number directly (tests, local runs).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if input_bytes and not shuffle_partitions:
        shuffle_partitions = partitions_for(input_bytes)
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = \
            str(shuffle_partitions)
        # on a shared cluster, merge towards the advisory size instead of
        # keeping many small tasks for the sake of parallelism
        settings["spark.sql.adaptive.coalescePartitions.parallelismFirst"] = "false"
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for staged tables and RDD checkpoints.

    Taken from the session (``spark.checkpoint.dir`` or a directory already
    set on the context).  A local-mode session without one uses a folder below
    its warehouse; on a cluster the setting is required, because staged tables
    must be on storage that all executors share.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) so staged tables survive executor loss")
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one staged table under the checkpoint root."""
    return f"{checkpoint_root(spark).rstrip('/')}/trackml/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None,
          path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the checkpoint root and read it back.

    This cuts the lineage (scans, joins, parsing) for every later pass and keeps
    the data on shared storage.  ``partition_by`` is for low-cardinality columns
    that later filters select on (e.g. ``subset``), so those filters prune
    whole directories.  With ``path`` the table replaces whatever that folder
    held (a reusable slot, e.g. one per sweep); otherwise a new folder is used.
    """
    spark = df.sparkSession
    if path is None:
        path, mode = stage_path(spark, name), "errorifexists"
    else:
        mode = "overwrite"
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    staged = spark.read.parquet(path)
    # partitioned columns come back last; keep the caller's column order
    out = staged.select(*df.columns)
    out._stage_path = path  # known to release() without listing files
    return out


def release(staged: DataFrame) -> list[str]:
    """Free the storage of a table returned by :func:`stage`.

    The folder is overwritten with an empty table of the same schema (plain
    ``DataFrame.write``; no file-system handles, no file listing).  Frames read
    from it are empty afterwards.  Returns the released folders.
    """
    path = getattr(staged, "_stage_path", None)
    if path is None:
        return []
    staged.sparkSession.createDataFrame([], staged.schema).write.mode("overwrite").parquet(path)
    return [path]
