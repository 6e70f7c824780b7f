"""Joins whose hot keys are dealt over many tasks, inside the lazy plan.

``hot_keys`` measures the sides' join keys in one job, by a mergeable
frequent-items sketch per side: the key columns alone are scanned, nothing is
shuffled by key, and the result is bounded.  For each hot key the rows of its largest side are
dealt over a number of parts, and the other sides' rows of that key are
repeated once for each part.  The sides are then joined on (key, part) in one
stage as before.  No session setting is involved; without a hot key the plan is
the plain join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: a key is hot above this share of its side's rows; it is dealt in parts of that size
HOT_SHARE = 1 / 1000
#: ... and above this number of rows, below which one task joins it quickly
MIN_HOT_ROWS = 100_000
#: keys that a side's sketch follows, and those it reports
TRACKED, REPORTED = 20_000, 1000
PART = "_part"


@dataclass(frozen=True)
class HotKey:
    key: object
    #: which side is dealt, and over how many parts
    side: int
    parts: int


def hot_keys(sides: list[DataFrame], key: str, share: float = HOT_SHARE,
             min_rows: int = MIN_HOT_ROWS) -> list[HotKey]:
    """The hot keys of several sides; NULL never joins and is left out.

    A key above ``share`` is always found: the sketch follows many times more
    keys than there can be of that size.  Its count is an estimate, which only
    sets the number of parts.
    """
    if share < 1 / REPORTED:
        raise ValueError(f"share must be {1 / REPORTED} or more, for at most {REPORTED} hot keys")
    keys = [s.select(F.lit(i).alias("side"), F.col(key).alias("k")) for i, s in enumerate(sides)]
    measured = reduce(DataFrame.union, keys).groupBy("side").agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"approx_top_k(k, {REPORTED}, {TRACKED})").alias("top"))
    found: dict[object, tuple[int, int, int]] = {}
    for r in measured.orderBy("side").collect():
        chunk = max(ceil(r["n"] * share), min_rows, 1)
        for t in r["top"]:
            if t["item"] is None or t["count"] <= chunk:
                continue
            if t["count"] > found.get(t["item"], (0,))[0]:
                found[t["item"]] = (t["count"], r["side"], ceil(t["count"] / chunk))
    return [HotKey(k, side, parts) for k, (_, side, parts) in found.items()]


def _hot_frame(spark: SparkSession, hot: list[HotKey], df: DataFrame, key: str) -> DataFrame:
    """At most ``REPORTED`` rows a side, so the broadcast is bounded."""
    kind = df.schema[key].dataType.simpleString()
    rows = [(h.key, h.side, h.parts) for h in hot]
    return F.broadcast(spark.createDataFrame(
        rows, f"_hot_key {kind}, _hot_side int, _hot_parts int"))


def deal(df: DataFrame, side: int, hot: list[HotKey], key: str) -> DataFrame:
    """``df`` with a ``PART`` column: hot rows dealt (on their side) or repeated.

    Rows are dealt by their place in their input partition, so inputs are files
    or staged tables, which a retried task reads in the same order.
    """
    frame = _hot_frame(df.sparkSession, hot, df, key)
    parts = F.col("_hot_parts")
    place = F.pmod(F.monotonically_increasing_id(), parts).cast("int")
    numbers = F.when(parts.isNull(), F.array(F.lit(0))) \
        .when(F.col("_hot_side") == side, F.array(place)) \
        .otherwise(F.sequence(F.lit(0), parts - 1))
    return df.join(frame, df[key] == frame["_hot_key"], "left").withColumn(
        "_numbers", numbers).select(*(df[c] for c in df.columns),
                                    F.explode("_numbers").alias(PART))


def join_on_key(sides: list[DataFrame], key: str, measured: list[int], share: float = HOT_SHARE,
                min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Inner equi-join of all sides on ``key``, key first, then each side's columns.

    ``measured`` names the sides whose keys may repeat.
    """
    found = hot_keys([sides[i] for i in measured], key, share, min_rows)
    hot = [HotKey(h.key, measured[h.side], h.parts) for h in found]
    on = [key]
    if hot:
        sides = [deal(s, i, hot, key) for i, s in enumerate(sides)]
        on.append(PART)
    out = sides[0]
    for s in sides[1:]:
        out = out.join(s, on)
    return out.drop(PART)
