"""The table of sweep results (S8): attempts on disk, one row per run on read.

Each result is written into a partition of its own, named by the run's key and
the attempt (one attempt per sweep).  The write replaces that partition alone
(dynamic partition overwrite), so writing a result again, after a crash or by a
retried task, leaves one copy; sweeps that run at the same time never touch
each other's partitions.  Readers take one attempt per run: a finished one
before a failed one, then the latest.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_KEY, ATTEMPT, FINISHED_AT = "run_key", "attempt", "finished_at"


def new_attempt() -> str:
    """A name no other sweep has."""
    return f"a-{uuid.uuid4().hex}"


def table_schema(schema: T.StructType) -> T.StructType:
    """The result columns with when and by which attempt a row was written."""
    own = [f for f in schema.fields if f.name != RUN_KEY]
    return T.StructType([*own, T.StructField(FINISHED_AT, T.DoubleType()),
                         T.StructField(RUN_KEY, T.StringType()),
                         T.StructField(ATTEMPT, T.StringType())])


def commit(rows: DataFrame, path: str, attempt: str) -> None:
    """Write the results of some runs; doing so again changes nothing but the time."""
    stamped = rows.withColumn(FINISHED_AT, F.lit(time.time())).withColumn(ATTEMPT, F.lit(attempt))
    stamped.select(*table_schema(rows.schema).names).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy(RUN_KEY, ATTEMPT).parquet(path)


def attempts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of the table; none where there is no table yet."""
    full = table_schema(schema)
    try:
        return spark.read.schema(full).option("basePath", path).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], full)


def read(spark: SparkSession, path: str, schema: T.StructType,
         keys: list[str] | None = None) -> DataFrame:
    """One row per run, in the result columns and ``n_attempts``; ``keys`` prunes partitions."""
    held = attempts(spark, path, schema)
    if keys is not None:
        held = held.where(F.col(RUN_KEY).isin(keys))
    order = F.struct((F.col("status") == "done").alias("done"), FINISHED_AT, ATTEMPT)
    latest = held.groupBy(RUN_KEY).agg(
        F.max_by(F.struct(*(F.col(c) for c in schema.names if c != RUN_KEY)), order).alias("r"),
        F.countDistinct(ATTEMPT).alias("n_attempts"))
    return latest.select(RUN_KEY, "r.*", "n_attempts").select(*schema.names, "n_attempts")
