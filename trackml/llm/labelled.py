"""Labelled rows for training: who may be learned from, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: remainders of crc32(doc_id as text) modulo 4
HELD_OUT, CALIBRATION = 2, 3


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def usable(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, label, fold`` of every document of class 0 or 1, never held out.

    Rows without id or label are left out; a document with both labels counts as 1.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label"))
    return own.withColumn("fold", fold()).where(
        (F.col("fold") != HELD_OUT) & F.col("label").isin(0, 1))


def sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` documents of each class of :func:`usable`, by a hash of the id."""
    own = usable(labels, label)
    parts = [own.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
             for c in (0, 1)]
    return parts[0].union(parts[1])


#: a text may take this share of a sample's size at the most, else it is left out
TEXT_SHARE = 0.01


def within(sized: DataFrame, size: str, most: int) -> DataFrame:
    """The first rows, in hash order, whose sizes add up to ``most`` at the most.

    A row above ``TEXT_SHARE`` of ``most`` is left out and does not end the
    sample.  For staged samples only: they have a bounded number of rows, of
    which the sum reads ids and sizes alone.
    """
    rows = sized.withColumn("_row", F.monotonically_increasing_id())
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "_row")
    first = rows.select("_row", "doc_id", size).where(F.col(size) <= most * TEXT_SHARE).withColumn(
        "_sum", F.sum(size).over(order)).where(F.col("_sum") <= most).select("_row")
    return rows.join(first, "_row").drop("_row")
