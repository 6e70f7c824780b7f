"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits, A-Z folded.  A document and a benchmark
item are compared when they share a seed (``least`` consecutive tokens; an item
shorter than that is its own seed).  Seeds bound the item's coverage from
above; pairs that can reach the threshold are tiled: the longest matches of
free tokens are found by running Karp-Rabin hashes over shrinking lengths and
marked on both sides (of equal ones the first in the item, then in the
document), and the search goes on until no match of ``least`` tokens is left.  Tiles may lie anywhere in the document, so passages whose parts were
put in another order are caught.  An item leaks when its tiles cover at least
``threshold`` of its tokens.

The benchmark is read in blocks of at most ``BLOCK_TOKENS`` tokens; each block
goes to the tasks as seed arrays and meets all documents in one pass, so a
larger benchmark means more passes and not more memory.

Defined cases: a null or empty text has no tokens and leaks nothing; an item
without tokens leaks nowhere.  Rows that share a doc_id (null included) are one
document and get the same result.  Items with equal ids count as one item with
several texts.  Only doc_id, item_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackml.llm import text as T
from trackml.llm.scratch import Scratch, bound_batches

BLOCK_TOKENS = 1 << 20
#: pairs of places measured at a time
PAIRS = 1 << 18


def tokens(s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a slice and the first token of each document."""
    w = T.words(s, T.ALNUM)
    return T.word_hashes(s, w, lower=True), w.first


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Running hash of every ``n`` consecutive tokens."""
    starts = np.arange(max(0, len(hashes) - n + 1))
    return T.run_hashes(hashes, starts, starts + n)


class _Sums:
    """Running sums of a token sequence: a hash of any range, for comparing ranges."""

    def __init__(self, h: np.ndarray):
        up, self.down = T.word_powers(len(h) + 1)
        self.total = np.zeros(len(h) + 1, T.U64)
        np.cumsum(h * up[:-1], out=self.total[1:])

    def of(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return (self.total[starts + lengths] - self.total[starts]) * self.down[starts]


class _Side:
    """An item or document: tokens, which are free, and ranges of free tokens."""

    def __init__(self, tokens_: np.ndarray):
        self.tokens, self.free = tokens_, np.ones(len(tokens_), bool)
        self.sums = _Sums(tokens_)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of ``length`` free tokens in a row, and their hashes."""
        starts = np.arange(max(0, len(self.tokens) - length + 1))
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        starts = starts[taken[starts + length] == taken[starts]]
        return starts, self.sums.of(starts, np.full(len(starts), length))

    def room(self) -> np.ndarray:
        """Free tokens from each place on."""
        place = np.arange(len(self.free))
        stop = np.where(self.free, len(self.free), place)
        return np.minimum.accumulate(stop[::-1])[::-1] - place

    def opens(self, starts: np.ndarray) -> np.ndarray:
        """Where no free token stands before a start."""
        return (starts == 0) | ~self.free[starts - 1]

    def take(self, start: int, length: int) -> None:
        self.free[start:start + length] = False


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: ``(item start, document start, length)`` of each tile."""
    a, b = _Side(item), _Side(doc)
    out: list[tuple[int, int, int]] = []
    length = max(least, len(item) // 2)
    while True:
        n, at_item, at_doc = _longest(a, b, length)
        marked = len(out)
        for i, j in zip(at_item.tolist(), at_doc.tolist(), strict=True):
            if a.free[i:i + n].all() and b.free[j:j + n].all():
                a.take(i, n)
                b.take(j, n)
                out.append((i, j, n))
        if len(out) > marked:
            continue
        if length == least:
            return out
        length = max(least, length // 2)


def _longest(a: _Side, b: _Side, length: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The longest matches of at least ``length`` free tokens, by item and document place.

    Windows are paired by hash, but only where a match starts: where the tokens
    before both differ, or one side has no free token there.  The pairs are
    measured ``PAIRS`` at a time, so very repetitive texts need no more memory.
    """
    at_item, keys = a.windows(length)
    at_doc, other = b.windows(length)
    keep = np.isin(other, keys)
    at_doc, other = at_doc[keep], other[keep]
    order = np.argsort(other, kind="stable")
    at_doc, other = at_doc[order], other[order]
    opens_doc = b.opens(at_doc)
    room_a, room_b = a.room(), b.room()
    opens_item = a.opens(at_item)
    # item places by key, and within a key by the token before them
    before = np.where(opens_item, 0, a.tokens[at_item - 1]) if len(at_item) else at_item
    groups: dict[tuple[int, bool, int], list[int]] = {}
    for i, k, o, t in zip(at_item.tolist(), keys.tolist(), opens_item.tolist(), before.tolist(),
                          strict=True):
        groups.setdefault((k, o, t), []).append(i)
    best, found = length, []
    for (key, opens, token), starts in groups.items():
        lo, hi = np.searchsorted(other, T.U64(key), "left"), \
            np.searchsorted(other, T.U64(key), "right")
        there = at_doc[lo:hi]
        if not opens:
            there = there[opens_doc[lo:hi] | (b.tokens[there - 1] != T.U64(token))]
        # a match longer than the best so far needs as much room
        there = there[room_b[there] >= best]
        starts = [i for i in starts if room_a[i] >= best]
        if not starts or not len(there):
            continue
        step = max(1, PAIRS // len(there))
        for p in range(0, len(starts), step):
            for q in range(0, len(there), PAIRS):
                part = there[q:q + PAIRS]
                i = np.repeat(np.array(starts[p:p + step]), len(part))
                j = np.tile(part, len(starts[p:p + step]))
                n = _extents(a, b, i, j, np.minimum(room_a[i], room_b[j]), length)
                top = int(n.max())
                if top < best:
                    continue
                if top > best:
                    best, found = top, []
                found.append((i[n == top], j[n == top]))
    if not found:
        return 0, np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((j, i))
    return best, i[order], j[order]


def _extents(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, most: np.ndarray,
             least: int) -> np.ndarray:
    """How many tokens from each pair of places on are equal, ``least`` at the least."""
    low, high = np.full(len(i), least), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = a.sums.of(i, middle) == b.sums.of(j, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


class Block:
    """Some benchmark items as token hashes with their seeds."""

    def __init__(self, items: list[tuple[int, np.ndarray]], least: int):
        self.items, self.least = items, least
        self.seeds = []
        for n in sorted({min(least, len(t)) for _, t in items if len(t)}):
            own = [k for k, (_, t) in enumerate(items) if min(least, len(t)) == n]
            grams = [windows(items[k][1], n) for k in own]
            seed = np.concatenate(grams)
            order = np.argsort(seed, kind="stable")
            item = np.repeat(own, [len(g) for g in grams])[order]
            place = np.concatenate([np.arange(len(g)) for g in grams])[order]
            self.seeds.append((n, seed[order], item, place))

    def candidates(self, doc: np.ndarray, threshold: float) -> Iterator[int]:
        """Items whose shared seeds cover enough tokens for the threshold."""
        for n, seed, item, place in self.seeds:
            here = np.unique(windows(doc, n))
            lo, hi = (np.searchsorted(seed, here, side) for side in ("left", "right"))
            hits = T.ranges(lo, hi - lo)
            for k in np.unique(item[hits]).tolist():
                size = len(self.items[k][1])
                edge = np.zeros(size + 1, np.int64)
                at = place[hits[item[hits] == k]]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + n, -1)
                if (np.cumsum(edge[:-1]) > 0).sum() >= threshold * size:
                    yield k

    def live(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Documents of a slice that hold any seed."""
        out = set()
        for n, seed, _, _ in self.seeds:
            grams, begin = T.ngrams(hashes, first, n)
            at = np.searchsorted(seed, grams)
            at[at == len(seed)] = 0
            hit = np.flatnonzero(seed[at] == grams)
            out.update((np.searchsorted(begin, hit, "right") - 1).tolist())
        return np.array(sorted(out), np.int64)

    def leaks(self, doc: np.ndarray, threshold: float) -> Iterator[tuple]:
        """``(item id, tokens, covered tokens, tiles)`` of the items that leak into a document."""
        for k in self.candidates(doc, threshold):
            item_id, item = self.items[k]
            found = tiles(item, doc, min(self.least, len(item)))
            covered = sum(n for _, _, n in found)
            if covered >= threshold * len(item):
                yield item_id, len(item), covered, sorted(found)


def _find(shared, threshold: float):
    def run(batches):
        block = shared.value
        for batch in batches:
            ids = T.column(batch, "doc_id")
            for s in T.slices(T.column(batch, "text")):
                hashes, first = tokens(s)
                rows = [{"doc_id": ids[s.lo + i].as_py(), "item_id": item_id, "n_tokens": size,
                         "covered": covered, "coverage": covered / size,
                         "tiles": [{"item_start": x, "doc_start": y, "length": n}
                                   for x, y, n in found]}
                        for i in block.live(hashes, first).tolist()
                        for item_id, size, covered, found in block.leaks(
                            hashes[first[i]:first[i + 1]], threshold)]
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
    return run


def _keep(shared, threshold: float):
    def run(batches):
        block = shared.value
        for batch in batches:
            for s in T.slices(T.column(batch, "text")):
                hashes, first = tokens(s)
                clean = np.ones(s.hi - s.lo, bool)
                for i in block.live(hashes, first).tolist():
                    clean[i] = next(block.leaks(hashes[first[i]:first[i + 1]], threshold),
                                    None) is None
                yield batch.slice(s.lo, s.hi - s.lo).filter(pa.array(clean))
    return run


_LEAK = ("doc_id long, item_id long, n_tokens int, covered int, coverage double, "
         "tiles array<struct<item_start:int,doc_start:int,length:int>>")
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_tokens", pa.int32()),
    ("covered", pa.int32()), ("coverage", pa.float64()),
    ("tiles", pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()),
                                  ("length", pa.int32())])))])


def blocks(benchmark: DataFrame, least: int) -> Iterator[Block]:
    """The benchmark's items, ``BLOCK_TOKENS`` at a time."""
    items, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                                "text").toLocalIterator():
        [s] = T.slices(pa.array([row.text], pa.string()))
        hashes, _ = tokens(s)
        if len(hashes):
            items.append((row.item_id, hashes))
            size += len(hashes)
        if size >= BLOCK_TOKENS:
            yield Block(items, least)
            items, size = [], 0
    if items:
        yield Block(items, least)


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5,
          threshold: float = 0.5) -> DataFrame:
    """A row per document and leaking item: coverage and tiles (token places)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tiling")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], _LEAK)
    for k, block in enumerate(blocks(benchmark, least)):
        shared = spark.sparkContext.broadcast(block)
        out = out.union(scratch.put(f"block{k}", source.mapInArrow(
            _find(shared, threshold), _LEAK)))
        shared.unpersist()
    return out


def clean_rows(docs: DataFrame, benchmark: DataFrame, least: int = 5,
               threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, into whose text no item leaks."""
    bound_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    for block in blocks(benchmark, least):
        docs = docs.mapInArrow(_keep(context.broadcast(block), threshold), docs.schema)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 5,
                  threshold: float = 0.5) -> DataFrame:
    """``doc_id, contaminated, n_items, item_id, coverage, n_tiles`` per row.

    The item is the one with the highest coverage, then the smallest id.
    """
    found = leaks(docs, benchmark, least, threshold)
    best = found.groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"),
        F.min(F.struct((-F.col("coverage")).alias("worse"), F.col("item_id"),
                       F.size("tiles").alias("n_tiles"))).alias("best")).select(
        F.col("doc_id").alias("leaky"), "n_items", F.col("best.item_id").alias("item_id"),
        (-F.col("best.worse")).alias("coverage"), F.col("best.n_tiles").alias("n_tiles"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(best, ids.doc_id.eqNullSafe(best.leaky), "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id",
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("n_tiles", F.lit(0)).alias("n_tiles"))
