"""Connected components of an edge table, as Spark jobs.

Large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond"): each step links a node's neighbours to the smallest
node around it, so the edge count never grows, and after a few rounds every
component is a star around its smallest node.  The minima of the large-star
step are written to the scratch folder before they are joined, so a hub's
edges can be split by AQE.

Before the first step every partition replaces its edges by stars around the
smallest node of each component it sees, first where the edges lie and then
with all edges of an upper node together.  That keeps the components and never
adds an edge.  After the first pass a node has at most one edge to a smaller
one per partition, so a hub is no large group in the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackml.llm import text as T
from trackml.llm.scratch import Scratch

#: edges that a task gathers before it contracts them
_GATHER = 1 << 20


def components(scratch: Scratch, name: str, edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; root is the component's minimum.

    Null ends and self-links are ignored; an edge may repeat.
    """
    cur = scratch.put(f"{name}0", _contracted(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    step = 0
    while not _is_star(cur):
        step += 1
        both = cur.union(cur.select("v", "u"))
        lowest = scratch.put(f"{name}L{step}", both.groupBy("u").agg(
            F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.put(f"{name}l{step}", _relink(both.where("v > u"), lowest).distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _relink(large, lowest).union(lowest)
        nxt = scratch.put(f"{name}{step}", small.distinct())
        scratch.drop(f"{name}{step - 1}", f"{name}L{step}", f"{name}l{step}")
        cur = nxt
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        cur.select("v", "v").distinct())


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One edge per node that is not the smallest of its component, to that smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the partition's edges; what is held grows with its nodes, not its edges."""
    held = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    size = limit = 0
    for batch in batches:
        held.append((T.column(batch, "u").to_numpy(), T.column(batch, "v").to_numpy()))
        size += batch.num_rows
        if size > limit + _GATHER:
            held = [stars(*map(np.concatenate, zip(*held)))]
            size = limit = len(held[0][0])
    u, v = stars(*map(np.concatenate, zip(*held)))
    for lo in range(0, len(u), 1 << 16):
        yield pa.record_batch([pa.array(u[lo:lo + (1 << 16)]), pa.array(v[lo:lo + (1 << 16)])],
                              names=["u", "v"])


def _contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: per partition, then per upper node's partition."""
    return (edges.mapInArrow(_local_stars, "u long, v long").repartition("u")
            .mapInArrow(_local_stars, "u long, v long").distinct())


def _relink(pairs: DataFrame, lowest: DataFrame) -> DataFrame:
    """Link each neighbour ``v`` of ``u`` to the smallest node at or around ``u``."""
    return pairs.join(lowest, "u").where("v <> m").select(
        F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))


def _is_star(edges: DataFrame) -> bool:
    """Whether every upper node has one edge and no lower node is an upper one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")) \
        .union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
    return nodes.where("up > 1 or (up = 1 and low = 1)").isEmpty()
