"""Joining the inputs, choosing feature columns, assembling vectors, splitting.

Inventory: J1, J2, P2-P6, F1, R1-R3.

The joins are plain inner equi-joins on ``track_id``.  All of them use the same
key, so with sort-merge every input is shuffled once and the two joins run in
one stage; a side whose measured size is small is broadcast instead by AQE.
Duplicate keys multiply rows and NULL keys never match (inner-join semantics of
the reference).  Keys that hold a large share of a side's rows are measured and
dealt over many tasks.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackml.functions.columns import INTEGRAL, key_bucket
from trackml.operators.skew import join_on_key
from trackml.sources.files import KEY, LABEL, SUBSET, YEAR

FEATURES = "features"
FOLD = "fold"
TRAIN = "TRAIN"
TEST = "TEST"

# Columns that are never features (P5): key, targets, partition, fold.
NON_FEATURES = (KEY, LABEL, SUBSET, YEAR, FOLD)


def join_tracks(splits: DataFrame, labels: DataFrame, features: DataFrame, **skew) -> DataFrame:
    """``splits ⋈ labels ⋈ features``; key once, then splits, labels, features columns.

    Tracks that repeat in the splits or labels are measured first, and a hot
    one is dealt over many tasks (:mod:`trackml.operators.skew`; ``skew`` are
    its thresholds).  Feature rows are one per track.
    """
    return join_on_key([splits, labels, features], KEY, measured=[0, 1], **skew)


def join_year(labels: DataFrame, features: DataFrame, **skew) -> DataFrame:
    """``labels ⋈ features`` for the year job; hot tracks of the labels are dealt as in J1."""
    return join_on_key([labels, features], KEY, measured=[0], **skew)


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = NON_FEATURES) -> list[str]:
    """P5: every column except the known non-features, in frame order."""
    return [c for c in df.columns if c not in exclude]


def _as_vector_input(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.ArrayType):
        return array_to_vector(F.col(name)).alias(name)
    return F.col(name)


def assemble(df: DataFrame, inputs: list[str] | None = None, output: str = FEATURES,
             handle_invalid: str = "error", keep: tuple[str, ...] | None = None) -> DataFrame:
    """assemble feature columns into one vector column.

    ``inputs`` defaults to :func:`feature_columns`.  Numeric columns and array
    columns (converted with ``array_to_vector``) may be mixed; the vector keeps
    input order.  ``handle_invalid`` is Spark's: ``error`` (default, as in the
    reference), ``skip`` (drop rows with NULL/NaN) or ``keep``.
    Returns the kept non-feature columns plus ``output``.
    """
    if handle_invalid not in ("error", "skip", "keep"):
        raise ValueError(f"handle_invalid must be error, skip or keep, not {handle_invalid!r}")
    inputs = list(inputs) if inputs is not None else feature_columns(df)
    if not inputs:
        raise ValueError("no feature columns to assemble")
    keep = tuple(c for c in (keep if keep is not None else NON_FEATURES) if c in df.columns)
    prepared = df.select(*keep, *[_as_vector_input(df, c) for c in inputs])
    assembler = VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid=handle_invalid)
    return assembler.transform(prepared).select(*keep, output)


PACKED = "feature_values"


def pack_features(features: DataFrame, inputs: list[str] | None = None,
                  key: str = KEY) -> tuple[DataFrame, list[str]]:
    """F1, first half: the feature columns of the features table packed into one
    ``array<double>`` column (``feature_values``), before any join.

    Array-typed inputs (e.g. an embedding) are spliced in place, so the slot
    order is the column order.  A join and its shuffle then carry two columns
    instead of hundreds, and every later stage stays under
    ``spark.sql.codegen.maxFields`` (whole-stage codegen).  NULL and NaN are
    kept as they are; :func:`vectorize` applies the invalid-value rule after
    the join, as assembling after the join would.

    Returns the packed frame and the slot names (array inputs give
    ``name_0, name_1, ...``, which needs one row to know their length).
    """
    inputs = list(inputs) if inputs is not None else [c for c in features.columns if c != key]
    if not inputs:
        raise ValueError("no feature columns to pack")
    parts, names = [], []
    for c in inputs:
        dtype = features.schema[c].dataType
        if isinstance(dtype, T.ArrayType):
            n = _array_width(features, c)
            parts.append(F.transform(F.col(c), lambda x: x.cast("double")))
            names.extend(f"{c}_{i}" for i in range(n))
        else:
            parts.append(F.array(F.col(c).cast("double")))
            names.append(c)
    packed = parts[0] if len(parts) == 1 else F.concat(*parts)
    return features.select(F.col(key), packed.alias(PACKED)), names


def _array_width(features: DataFrame, name: str) -> int:
    """The length all non-NULL arrays of a column share."""
    low, high = features.where(F.col(name).isNotNull()).agg(
        F.min(F.size(name)), F.max(F.size(name))).first()
    if low != high:
        raise ValueError(f"arrays in {name!r} have {low} to {high} values; "
                         "feature arrays need one length")
    return low or 0


def _attribute_metadata(names: list[str]) -> dict:
    """ML attribute metadata of a numeric vector (what ``VectorAssembler`` writes)."""
    return {"ml_attr": {"attrs": {"numeric": [{"idx": i, "name": n} for i, n in enumerate(names)]},
                        "num_attrs": len(names)}}


def vectorize(df: DataFrame, names: list[str], output: str = FEATURES,
              handle_invalid: str = "error", packed: str = PACKED) -> DataFrame:
    """F1, second half: packed values → ML vector, with ``VectorAssembler``'s
    invalid-value rule: ``error`` fails on a NULL or NaN value, ``skip`` drops
    the row, ``keep`` keeps it with NULL as NaN."""
    if handle_invalid not in ("error", "skip", "keep"):
        raise ValueError(f"handle_invalid must be error, skip or keep, not {handle_invalid!r}")
    values = F.col(packed)
    invalid = values.isNull() | F.exists(values, lambda x: x.isNull() | F.isnan(x))
    if handle_invalid == "skip":
        df = df.where(~invalid)
    elif handle_invalid == "error":
        values = F.when(invalid, F.raise_error(F.concat(
            F.lit("invalid (NULL or NaN) feature value for key "),
            F.col(KEY).cast("string"),
            F.lit("; use handle_invalid='skip' or 'keep'")))).otherwise(values)
    else:
        values = F.transform(values, lambda x: F.coalesce(x, F.lit(float("nan"))))
    values = F.when(F.size(packed) != len(names), F.raise_error(F.lit(
        f"a row does not have the {len(names)} named feature values"))).otherwise(values)
    vector = array_to_vector(values).alias(output, metadata=_attribute_metadata(names))
    return df.select(*[c for c in df.columns if c != packed], vector)


def select_rename(df: DataFrame, columns: list[str], renames: dict[str, str]) -> DataFrame:
    """P3 + P4: select columns, then rename some of them."""
    out = df.select(*columns)
    for old, new in renames.items():
        out = out.withColumnRenamed(old, new)
    return out


def subset_rows(df: DataFrame, subset: str) -> DataFrame:
    """Rows of one partition; other values and NULL are never selected."""
    return df.where(F.col(SUBSET) == F.lit(subset))


def split_by_subset(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) from the supplied partition column."""
    return subset_rows(df, TRAIN), subset_rows(df, TEST)


def random_split(df: DataFrame, train_fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """R2 as in the reference (``randomSplit``), with an explicit seed."""
    if not 0.0 < train_fraction < 1.0:
        raise ValueError("train_fraction must be in (0, 1)")
    train, test = df.randomSplit([train_fraction, 1.0 - train_fraction], seed=seed)
    return train, test


def key_split(df: DataFrame, train_fraction: float, buckets: int = 100,
              key: str = KEY, method: str = "auto") -> DataFrame:
    """R2, reproducible: label every row TRAIN/TEST from a bucket of its key.

    No sort, no shuffle, same result on every run and engine; all rows kept.
    """
    if method == "hash" or not isinstance(df.schema[key].dataType, INTEGRAL):
        buckets = 1 << 31  # any fraction, not whole percents
    cut = int(round(train_fraction * buckets))
    if not 0 < cut < buckets:
        raise ValueError("train_fraction leaves one side empty")
    bucket = key_bucket(F.col(key), df.schema[key].dataType, buckets, method)
    return df.withColumn(SUBSET, F.when(bucket < cut, F.lit(TRAIN)).otherwise(F.lit(TEST)))


def assign_folds(df: DataFrame, num_folds: int, key: str = KEY,
                 method: str = "auto") -> DataFrame:
    """Fold number in ``[0, num_folds)`` from the key (for ``CrossValidator.foldCol``)."""
    if num_folds < 2:
        raise ValueError("num_folds must be at least 2")
    fold = key_bucket(F.col(key), df.schema[key].dataType, num_folds, method).cast("int")
    return df.withColumn(FOLD, fold)
