"""Near-duplicate groups by b-bit MinHash, confirmed on whole shingle sets.

1. Each text becomes its set of word shingles; texts with the same set are one
   class, represented by the smallest doc_id (rows pre-aggregate on the set's
   128-bit key, so thousands of copies cost one representative).
2. Band candidates: ``bands`` keys of ``rows`` minima each per representative.
   The number of bands follows from the similarity and ``miss``, the chance
   that a pair exactly at the threshold shares no band.  Every bucket member
   is linked to the bucket's smallest member; the components of these links
   are clusters, so a linked pair always lies within one cluster.
3. Clusters are compared in blocks (at most ``BLOCK`` representatives or
   ``BLOCK_BYTES`` of shingles): the low two bits of the minima, packed, give a
   similarity estimate corrected for chance matches by bit counts; texts with a
   partner above the threshold less six standard errors go on, and their exact
   intersections decide.  A task returns at most one link per text and block
   pair (its spanning links), never all pairs.
4. Components of the confirmed links are the groups.

Defined cases: a text without words (null, empty) has an empty set and is
linked with nothing; fewer words than a shingle make one shingle of all words.
A row without doc_id is signed but never linked (component null, kept).  Rows
that share a doc_id count as one document.  Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackml.llm import text as T
from trackml.llm.graph import components
from trackml.llm.scratch import Scratch

BLOCK = 512
BLOCK_BYTES = 4 << 20
LANE_BITS = 2
_EVEN = np.uint64(0x5555555555555555)


@dataclass(frozen=True)
class Params:
    """Shingle length in words, similarity as an exact fraction, band shape."""

    words: int = 5
    percent: int = 80
    rows: int = 7
    miss: float = 1e-6

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def minima(self) -> int:
        return self.bands * self.rows


def shingle_sets(s: T.Slice, p: Params) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document of the slice."""
    w = T.words(s)
    hashes = T.word_hashes(s, w, lower=True)
    grams, first = T.ngrams(hashes, w.first, p.words)
    count = w.count()
    short = (count > 0) & (count < p.words)
    whole = T.run_hashes(hashes, w.first[:-1][short], w.first[1:][short])
    at = np.cumsum(short) - 1
    for i in range(len(count)):
        if short[i]:
            # a whole short sequence is never equal to a full shingle
            yield T.mix(whole[at[i]:at[i] + 1] + np.uint64(count[i]))
        else:
            yield np.unique(grams[first[i]:first[i + 1]])


class Signer:
    """Minima of ``p.minima`` hash functions, their band keys and packed low bits."""

    def __init__(self, p: Params):
        self.p = p
        v = T.seeds(29, 2 * p.minima)
        self.a = (v[:p.minima] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.b = (v[p.minima:] >> np.uint64(32)).astype(np.uint32)
        self.mult = T.seeds(31, p.rows) | np.uint64(1)
        self.tag = T.seeds(37, p.bands)
        self.lanes = math.ceil(p.minima / 32) * 32
        self.shift = (np.arange(32, dtype=np.uint64) * np.uint64(LANE_BITS))

    def minimum(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.p.minima, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 2048):
            np.minimum(low, (x[i:i + 2048, None] * self.a + self.b).min(axis=0), out=low)
        return low

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        m = minima.astype(np.uint64).reshape(-1, self.p.bands, self.p.rows)
        return T.mix((m * self.mult).sum(axis=2, dtype=np.uint64) + self.tag)

    def pack(self, minima: np.ndarray) -> np.ndarray:
        """Low bits of the (mixed) minima, 32 lanes to a word; padding lanes are 0."""
        low = T.mix(minima.astype(np.uint64)) & np.uint64((1 << LANE_BITS) - 1)
        out = np.zeros((len(minima), self.lanes), np.uint64)
        out[:, :self.p.minima] = low
        return (out.reshape(len(minima), -1, 32) << self.shift).sum(axis=2, dtype=np.uint64)


def set_key(shingles: np.ndarray) -> bytes:
    """128-bit key of a set: its size and two order-free sums of mixed members."""
    sums = np.array([shingles.sum(dtype=np.uint64),
                     T.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])
    return T.mix(sums + np.array([len(shingles)], np.uint64)).tobytes()


_SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<bigint>"
_MEMBER = "node long, root long, blocks int, block int, n long, shingles binary, packed binary"
_LINK = "a long, b long"


def _sign(p: Params):
    def run(batches):
        signer = Signer(p)
        for batch in batches:
            ids = T.column(batch, "doc_id")
            for s in T.slices(T.column(batch, "text")):
                n = s.hi - s.lo
                minima = np.zeros((n, p.minima), np.uint32)
                sizes, keys = np.zeros(n, np.int64), []
                for i, shingles in enumerate(shingle_sets(s, p)):
                    sizes[i] = len(shingles)
                    keys.append(set_key(shingles) if len(shingles) else None)
                    if len(shingles):
                        minima[i] = signer.minimum(shingles)
                full = sizes > 0
                bands = signer.band_keys(minima[full]).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(full * p.bands)]).astype(np.int32)
                yield pa.record_batch([
                    ids.slice(s.lo, n), pa.array(sizes), pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1)))],
                    names=["doc_id", "n_shingles", "set_key", "bands"])
    return run


def _members(p: Params):
    """Shingles and packed bits of the cluster members, once their set is the expected one."""
    def run(batches):
        signer = Signer(p)
        for batch in batches:
            expected = T.column(batch, "set_key")
            for s in T.slices(T.column(batch, "text")):
                rows, sets, packed = [], [], []
                for i, shingles in enumerate(shingle_sets(s, p)):
                    if len(shingles) and set_key(shingles) == expected[s.lo + i].as_py():
                        rows.append(s.lo + i)
                        sets.append(shingles.tobytes())
                        packed.append(signer.pack(signer.minimum(shingles)[None]).tobytes())
                kept = batch.take(pa.array(rows, pa.int64()))
                yield pa.record_batch([
                    T.column(kept, "node"), T.column(kept, "root"), T.column(kept, "blocks"),
                    T.column(kept, "block"), T.column(kept, "n"),
                    pa.array(sets, pa.binary()), pa.array(packed, pa.binary())],
                    names=["node", "root", "blocks", "block", "n", "shingles", "packed"])
    return run


def estimated(packed: np.ndarray, i: np.ndarray, p: Params) -> np.ndarray:
    """Similarity of rows ``i`` with all rows, corrected for lanes equal by chance."""
    x = packed[i, None, :] ^ packed[None, :, :]
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & _EVEN).sum(axis=2, dtype=np.int32)
    chance = 0.5 ** LANE_BITS
    return (1 - differ / p.minima - chance) / (1 - chance)


def cutoff(p: Params) -> float:
    """The threshold less six standard errors of the estimate at the threshold."""
    t, chance = p.percent / 100, 0.5 ** LANE_BITS
    match = t + (1 - t) * chance
    return t - 6 * math.sqrt(match * (1 - match) / p.minima) / (1 - chance)


def spanning_links(block: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray],
                   packed: np.ndarray, p: Params) -> list[tuple[int, int]]:
    """Links that connect what the confirmed pairs of this block pair connect.

    With two blocks only pairs across them are compared; pairs within one block
    have a task of their own.
    """
    across = block.min() != block.max()
    cut, n = cutoff(p), len(sizes)
    wanted = np.zeros((n, n), bool)
    step = max(1, (1 << 21) // max(1, n * packed.shape[1]))
    for lo in range(0, n, step):
        i = np.arange(lo, min(n, lo + step))
        small, large = (f(sizes[i, None], sizes[None, :]) for f in (np.minimum, np.maximum))
        wanted[i] = (estimated(packed, i, p) >= cut) & (100 * small >= p.percent * large)
        if across:
            wanted[i] &= block[i, None] != block[None, :]
    np.fill_diagonal(wanted, False)
    live = np.flatnonzero(wanted.any(axis=1))
    if not len(live):
        return []
    values, where, seen = np.unique(np.concatenate([sets[i] for i in live]),
                                    return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(live)), sizes[live])
    shared = seen[where] > 1
    col = (np.cumsum(seen > 1) - 1)[where[shared]]
    row = row[shared]
    common = np.zeros((len(live), len(live)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = 4096
    for lo in range(0, int((seen > 1).sum()), width):
        a, b = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((len(live), width), np.float32)
        m[row[a:b], col[a:b] - lo] = 1
        common += m @ m.T
    common = common.astype(np.int64)
    union = sizes[live][:, None] + sizes[live][None, :] - common
    linked = wanted[np.ix_(live, live)] & (100 * common >= p.percent * union)
    label = np.arange(len(live))
    while True:
        near = np.where(linked, label[None, :], len(live)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(live[i]), int(live[r])) for i, r in enumerate(label) if i != r]


def _link(p: Params):
    def run(table: pa.Table) -> pa.Table:
        node = T.column(table, "node").to_numpy()
        _, keep = np.unique(node, return_index=True)
        table, node = table.take(pa.array(keep)), node[keep]
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in T.column(table, "shingles")]
        packed = np.stack([np.frombuffer(x.as_py(), np.uint64)
                           for x in T.column(table, "packed")])
        links = spanning_links(T.column(table, "block").to_numpy(),
                               np.array([len(x) for x in sets]), sets, packed, p)
        return pa.table({"a": pa.array([node[i] for i, _ in links], pa.int64()),
                         "b": pa.array([node[j] for _, j in links], pa.int64())})
    return run


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over confirmed links,
    ``kept`` whether the row is that document.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.put("signed", source.mapInArrow(_sign(p), _SIGNED))
    classes = scratch.put("classes", signed.where("set_key is not null and doc_id is not null")
                          .groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    members = _clusters(scratch, signed, classes)

    # one plan at every size: the member table grows with the corpus, so it is
    # merged with the texts and not broadcast while it happens to be small
    blocks = (source.join(members.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id")
              .withColumnRenamed("doc_id", "node")
              .select("node", "root", "blocks", "block", "n", "set_key", "text")
              .mapInArrow(_members(p), _MEMBER)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("root", F.least("block", "other").alias("i"),
                      F.greatest("block", "other").alias("j"), "node", "block",
                      "shingles", "packed"))
    links = scratch.put("links", blocks.groupBy("root", "i", "j").applyInArrow(_link(p), _LINK))
    groups = components(scratch, "group", links)
    found = scratch.put("found", classes.join(groups, classes.rep == groups.node, "left").select(
        "set_key", F.coalesce("root", "rep").alias("root")))
    scratch.drop("links", "members", "classes")
    return (signed.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(),
                                               F.coalesce("root", "doc_id")))
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
                    .alias("kept")))


def _clusters(scratch: Scratch, signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Representatives that share a bucket with another: node, root, set_key, n and block."""
    reps = signed.join(classes, "set_key").where("doc_id = rep").select(
        "rep", F.explode("bands").alias("band"))
    buckets = scratch.put("buckets", reps.groupBy("band").agg(
        F.min("rep").alias("low"), F.max("rep").alias("high"))
        .where("low < high").select("band", "low"))
    star = reps.join(buckets, "band").where("rep <> low").select(
        F.col("rep").alias("a"), F.col("low").alias("b"))
    clusters = scratch.put("clusters", components(scratch, "cluster", star))
    nodes = clusters.join(classes, clusters.node == classes.rep).join(
        signed.select("set_key", "doc_id", F.col("n_shingles").alias("n")).distinct(),
        "set_key").where("doc_id = node").select("node", "root", "set_key", "n")
    nodes = scratch.put("nodes", nodes)
    sizes = scratch.put("sizes", nodes.groupBy("root").agg(F.ceil(F.greatest(
        F.count("*") / F.lit(BLOCK), F.sum("n") * 8 / F.lit(BLOCK_BYTES))).cast("int")
        .alias("blocks")))
    members = scratch.put("members", nodes.join(sizes, "root").withColumn(
        "block", F.expr("pmod(xxhash64(node), blocks)").cast("int")))
    scratch.drop("buckets", "clusters", "nodes", "sizes")
    return members
