"""Readers for the three track inputs kept as delimited text.

* features: CSV with a header, a key column and N numeric columns whose names
  and count are only known from the header;
* genre/style labels: headerless TSV ``key, label``;
* partitions ("splits"): headerless TSV ``key, subset`` with ``%`` comments;
* year labels: CSV with a header holding the key, ``year`` and extra text
  columns that are dropped.

Schemas are always explicit (no ``inferSchema``: one bad cell would turn a
feature column into a string, and ids like ``T1`` would become timestamps).
Malformed records are told by reading in PERMISSIVE mode with a corrupt record
column and staging every column to Parquet once, so later column pruning cannot
change which rows count as malformed.  They are dropped from the rows and kept
in a quarantine table with the raw line and the reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackml.session import stage

CORRUPT = "_corrupt_record"

# Column names the reference's inputs use (fixed values).
SOURCE_KEY = "MSD_TRACKID"
YEAR_DROPPED = ("artist", "song")

# Names used throughout this package.
KEY = "track_id"
LABEL = "label"
SUBSET = "subset"
YEAR = "year"


def header_columns(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names from the header line (reads one line, no type inference)."""
    return spark.read.option("header", True).option("sep", sep).csv(path).columns


def _delimited(spark: SparkSession, path: str, schema: T.StructType, *,
               header: bool, sep: str, comment: str | None = None) -> DataFrame:
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    reader = (spark.read.schema(full)
              .option("header", header)
              .option("sep", sep)
              .option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT)
              .option("nanValue", "NaN"))
    if header:
        # a part file whose header has other columns or another order fails
        # instead of being read into the wrong columns
        reader = reader.option("enforceSchema", False)
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


@dataclass(frozen=True)
class Parsed:
    """One parse of an input: its well-formed rows, and the lines kept out of them."""

    rows: DataFrame
    #: ``line, reason``; reason is ``short``, ``long`` (number of fields) or ``value``
    quarantine: DataFrame


def _reason(line: Column, sep: str, fields: int) -> Column:
    """Why a line is malformed; separators inside quotes do not count."""
    bare = F.regexp_replace(line, r'"(?:[^"\\]|\\.)*+"', "")
    found = F.regexp_count(bare, F.lit(sep)) + 1
    return F.when(found < fields, "short").when(found > fields, "long").otherwise("value")


def _parse(raw: DataFrame, name: str, sep: str) -> Parsed:
    """Parse once, staging every column and the raw line of malformed rows.

    Both results read the staged table; the raw line is null in well-formed
    rows, so the filters reach its scan.
    """
    staged = stage(raw, name)
    rows = staged.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    rows._stage_path = staged._stage_path
    lines = staged.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"))
    return Parsed(rows, lines.withColumn(
        "reason", _reason(F.col("line"), sep, len(raw.columns) - 1)))


def parse_features_csv(spark: SparkSession, path: str, key: str = SOURCE_KEY,
                       key_type: T.DataType = T.StringType()) -> Parsed:
    """Features CSV → ``track_id`` + DOUBLE feature columns in file order."""
    names = header_columns(spark, path)
    if key not in names:
        raise ValueError(f"key column {key!r} not in header of {path}")
    fields = [T.StructField(n, key_type if n == key else T.DoubleType()) for n in names]
    raw = _delimited(spark, path, T.StructType(fields), header=True, sep=",")
    return _parse(raw.withColumnRenamed(key, KEY), "features", ",")


def parse_labels_tsv(spark: SparkSession, path: str,
                     key_type: T.DataType = T.StringType()) -> Parsed:
    """Headerless TSV → ``track_id, label``."""
    schema = T.StructType([T.StructField(KEY, key_type), T.StructField(LABEL, T.StringType())])
    return _parse(_delimited(spark, path, schema, header=False, sep="\t"), "labels", "\t")


def parse_splits_tsv(spark: SparkSession, path: str,
                     key_type: T.DataType = T.StringType()) -> Parsed:
    """Headerless TSV with ``%`` comment lines → ``track_id, subset``."""
    schema = T.StructType([T.StructField(KEY, key_type), T.StructField(SUBSET, T.StringType())])
    raw = _delimited(spark, path, schema, header=False, sep="\t", comment="%")
    return _parse(raw, "splits", "\t")


def parse_year_labels_csv(spark: SparkSession, path: str, key: str = SOURCE_KEY,
                          key_type: T.DataType = T.StringType()) -> Parsed:
    """Year labels CSV with header → ``track_id, year``.

    Extra text columns (artist, song) are read as strings so that their content
    cannot make a row malformed, then dropped (P2).
    """
    names = header_columns(spark, path)
    if key not in names or YEAR not in names:
        raise ValueError(f"{path} needs columns {key!r} and {YEAR!r}")
    types = {key: key_type, YEAR: T.IntegerType()}
    fields = [T.StructField(n, types.get(n, T.StringType())) for n in names]
    raw = _delimited(spark, path, T.StructType(fields), header=True, sep=",")
    parsed = _parse(raw.withColumnRenamed(key, KEY), "year_labels", ",")
    years = parsed.rows.drop(*[c for c in YEAR_DROPPED if c in parsed.rows.columns])
    years._stage_path = parsed.rows._stage_path
    return Parsed(years, parsed.quarantine)


def read_features_csv(spark: SparkSession, path: str, key: str = SOURCE_KEY,
                      key_type: T.DataType = T.StringType()) -> DataFrame:
    """The well-formed rows of :func:`parse_features_csv`."""
    return parse_features_csv(spark, path, key, key_type).rows


def read_labels_tsv(spark: SparkSession, path: str,
                    key_type: T.DataType = T.StringType()) -> DataFrame:
    """The well-formed rows of :func:`parse_labels_tsv`."""
    return parse_labels_tsv(spark, path, key_type).rows


def read_splits_tsv(spark: SparkSession, path: str,
                    key_type: T.DataType = T.StringType()) -> DataFrame:
    """The well-formed rows of :func:`parse_splits_tsv`."""
    return parse_splits_tsv(spark, path, key_type).rows


def read_year_labels_csv(spark: SparkSession, path: str, key: str = SOURCE_KEY,
                         key_type: T.DataType = T.StringType()) -> DataFrame:
    """The well-formed rows of :func:`parse_year_labels_csv`."""
    return parse_year_labels_csv(spark, path, key, key_type).rows


def read_track_inputs(spark: SparkSession, features_path: str, labels_path: str,
                      splits_path: str | None = None) -> dict[str, DataFrame]:
    """All inputs one experiment names; works for any Hadoop URI."""
    out = {"features": read_features_csv(spark, features_path),
           "labels": read_labels_tsv(spark, labels_path)}
    if splits_path:
        out["splits"] = read_splits_tsv(spark, splits_path)
    return out
