"""Column expressions (all built-in Spark functions, evaluated in the JVM)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def key_bucket(key: Column, dtype: T.DataType, buckets: int, method: str = "auto") -> Column:
    """Stable bucket in ``[0, buckets)``, the same on every run.

    ``auto``: ``key mod buckets`` for integer keys (also reproducible in any
    SQL engine), else of the key's xxhash64; ``hash``: always of the xxhash64
    (for integer keys with structure, e.g. all multiples of ``buckets``).
    """
    if method not in ("auto", "hash"):
        raise ValueError("method must be 'auto' or 'hash'")
    if method == "auto" and isinstance(dtype, INTEGRAL):
        return F.pmod(key, F.lit(buckets))
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def hit(truth: str, predicted: str) -> Column:
    """1.0 where the prediction equals the truth, else 0.0."""
    return (F.col(predicted) == F.col(truth)).cast("double")


def rounded(name: str, decimals: int) -> Column:
    """Round a float column for comparison across engines, keeping its name."""
    return F.round(F.col(name), decimals).alias(name)


def vector_slots(vector_col: str, names: list[str]) -> list[Column]:
    """One DOUBLE column per slot of a vector column."""
    arr = vector_to_array(F.col(vector_col))
    return [arr[i].alias(n) for i, n in enumerate(names)]
