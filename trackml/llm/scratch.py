"""Intermediate tables in the cluster's shared checkpoint folder.

Operators that read a result more than once, or that must cut a long lineage,
write it as Parquet below the folder of ``spark.checkpoint.dir`` and read it
back.  A lost executor then costs a re-read.  ``drop`` frees a table that no
later step reads.  A side read back from a table is a plain scan, so a join
with it has an exchange on both sides, which AQE can split on a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackml.session import stage_path


#: rows of a batch sent to Python, unless the session sets its own number; with
#: Spark's default of 10,000 rows a batch of texts takes tens of megabytes, several times
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Keep batches of whole texts small, for the memory of executors."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


class Scratch:
    """Named intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, label: str):
        bound_batches(spark)
        self.spark = spark
        self.label = label
        self._tables: dict[str, tuple[str, object]] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the table that reads it back."""
        path = stage_path(self.spark, f"{self.label}-{name}")
        df.write.parquet(path)
        self._tables[name] = (path, df.schema)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        """A fresh shared folder for files that tasks write themselves."""
        return stage_path(self.spark, f"{self.label}-{name}")

    def drop(self, *names: str) -> None:
        """Free tables: each folder is overwritten with an empty table."""
        for name in names:
            path, schema = self._tables.pop(name)
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
