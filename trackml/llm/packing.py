"""Best-fit packing of token sequences by a configuration linear program.

Documents are tokenized (``<|endoftext|>`` and other added tokens keep their
meaning), closed with an end id and, only where longer than the capacity, cut
into capacity-long pieces with the shorter piece first.

Which pieces share a sequence depends on the histogram of piece lengths alone,
at most ``capacity`` counts however large the corpus is.  Over it the driver
solves the configuration LP (one variable per way to fill a sequence) by
multiplicative weights: each step prices lengths by how little they are
covered, and a knapsack dynamic program finds the dearest configuration.  The
fractional solution is rounded down, the LP is solved again for what is left,
and the last few pieces are placed by best fit.

The result is a list of runs "pieces number r.. of length l go to sequences
s.. at offset o", bounded by the capacity and not by the corpus, which is
broadcast.  A piece's number among those of its length is its place in its
task (given while tokenizing) plus the counts of earlier tasks, so no length
is ever gathered in one task.

Defined cases: a null or empty text is the end id alone; a row without doc_id
is packed like any other; rows that repeat are packed each.  Only doc_id and
text are read.
"""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackml.llm import text as T
from trackml.llm.scratch import Scratch

CACHE_ENTRIES = 1 << 18
#: multiplicative weights: steps, fall of a price over full cover, largest
#: cover of a step, and how far below the dearest a configuration may be worth
STEPS, RATE, STEP, SLACK = 80, 4.0, 0.025, 0.05
#: most runs a plan may have before it is refused for broadcasting
PLAN_LIMIT = 500_000

# byte classes of the pre-tokenizer: a token is an optional space and a run of
# letters, digits or other signs; any other white space stands alone
_LETTER, _DIGIT, _SIGN, _BLANK, _BREAK, _ODD = range(1, 7)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[0x80:0xC0] = _CLASS[0xC3] = _LETTER
_CLASS[0x20] = _BLANK
_CLASS[[9, 10, 13]] = _BREAK
_CLASS[0x27] = _ODD


class Encoder:
    """Token ids of whole texts, equal to the tokenizer's own.

    Byte-level BPE works inside one pre-token at a time, so ids are kept per
    pre-token.  Texts whose pre-tokens the byte classes cannot tell for sure
    (apostrophes, doubled white space, letters beyond Latin-1, added tokens)
    go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in
                      self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(token)
        self.cache: dict[int, bytes] = {}

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _tokens(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens that hold no white space but a leading blank.

        They are encoded as lines of one text: a line break before a pre-token
        is a pre-token of its own, and the ids' byte lengths tell where each
        pre-token ends.
        """
        coded = self._batch(["\n" + b"\n".join(tokens).decode()])[0]
        ends = np.cumsum(self.length[np.frombuffer(coded, "<u4")])
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        last = np.cumsum(size + 1)
        stop = (np.searchsorted(ends, last) + 1) * 4
        begin = (np.searchsorted(ends, last - size) + 1) * 4
        return [coded[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]

    def _parts(self, texts: list[bytes]) -> list[bytes]:
        """Ids of any pre-tokens; white space alone is encoded by itself."""
        blank = [t.isspace() for t in texts]
        lines = [t for t, b in zip(texts, blank, strict=True) if not b]
        coded = iter(self._tokens(lines) if lines else [])
        others = iter(self._batch([t.decode() for t, b in zip(texts, blank, strict=True) if b]))
        return [next(others if b else coded) for b in blank]

    def encode(self, s: T.Slice) -> list[np.ndarray]:
        """Ids of each document of the slice."""
        n = len(s.offsets) - 1
        cls = _CLASS[s.data]
        odd = cls == _ODD
        space = (cls == _BLANK) | (cls == _BREAK)
        odd[1:] |= space[1:] & space[:-1]
        # multiplication and division signs lie among the Latin-1 letters
        odd[1:] |= (s.data[:-1] == 0xC3) & ((s.data[1:] == 0x97) | (s.data[1:] == 0xB7))
        full = np.diff(s.offsets) > 0
        plain = np.ones(n, bool)
        if len(cls):
            firsts = s.offsets[:-1][full]
            plain[full] = ~(np.logical_or.reduceat(odd, firsts) | space[s.offsets[1:][full] - 1])
        for i in np.flatnonzero(plain):
            text = s.text(i)
            if any(a in text for a in self.added):
                plain[i] = False
        out = self._plain(s, cls, full, plain)
        rest = [i for i in range(n) if not plain[i]]
        for i, ids in zip(rest, self._batch([s.text(i).decode() for i in rest]), strict=True):
            out[i] = np.frombuffer(ids, "<u4")
        return out

    def _plain(self, s: T.Slice, cls: np.ndarray, full: np.ndarray,
               plain: np.ndarray) -> list[np.ndarray]:
        """Ids of the plain documents; the others get none here."""
        start = np.ones(len(cls), bool)
        start[1:] = (cls[1:] != cls[:-1]) & (cls[:-1] != _BLANK)
        start[s.offsets[:-1][full]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(cls))
        keep = np.repeat(plain, np.diff(np.searchsorted(starts, s.offsets)))
        starts, ends = starts[keep], ends[keep]
        keys, at, which = np.unique(T.range_hashes(s.data, starts, ends)
                                    if len(starts) else np.empty(0, np.uint64),
                                    return_index=True, return_inverse=True)
        keys = keys.tolist()
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        coded = list(map(self.cache.get, keys))
        new = [k for k, c in enumerate(coded) if c is None]
        if new:
            raw = s.data.tobytes()
            texts = [raw[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(),
                                              strict=True)]
            for k, ids in zip(new, self._parts(texts), strict=True):
                coded[k] = self.cache[keys[k]] = ids
        length = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat = np.frombuffer(b"".join(coded), "<u4")
        begin = np.cumsum(length) - length
        ids = flat[T.ranges(begin[which], length[which])] if len(starts) else flat
        stop = np.concatenate([[0], np.cumsum(length[which])]) if len(starts) else np.zeros(1, int)
        cut = stop[np.searchsorted(starts, s.offsets)]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_PIECE = ("doc_id long, piece int, start long, length long, ids binary, part int, place long")


def _cut(path: str, end_id: int, capacity: int):
    def run(batches):
        enc, part = encoder(path), TaskContext.get().partitionId()
        placed = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids = T.column(batch, "doc_id")
            for s in T.slices(T.column(batch, "text")):
                row, piece, start, length, data, place = ([] for _ in range(6))
                for i, tokens in enumerate(enc.encode(s)):
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    n = -(-len(tokens) // capacity)
                    cuts = [0, *range(len(tokens) - (n - 1) * capacity, len(tokens) + 1, capacity)]
                    for k in range(n):
                        size = cuts[k + 1] - cuts[k]
                        row.append(s.lo + i)
                        piece.append(k)
                        start.append(cuts[k])
                        length.append(size)
                        data.append(tokens[cuts[k]:cuts[k + 1]].tobytes())
                        place.append(placed[size])
                        placed[size] += 1
                yield pa.record_batch([
                    ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(data, pa.binary()), pa.array([part] * len(row), pa.int32()),
                    pa.array(place, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids", "part", "place"])
    return run


class Knapsack:
    """Dearest filling of every capacity up to ``capacity``, sizes may repeat."""

    def __init__(self, value: np.ndarray, sizes: np.ndarray, capacity: int):
        self.sizes = sizes
        self.best = np.zeros(capacity + 1)
        self.pick = np.full(capacity + 1, -1)
        fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
        for c in range(1, capacity + 1):
            self.best[c] = self.best[c - 1]
            k = fits[c]
            if k:
                got = self.best[c - sizes[:k]] + value[:k]
                i = int(got.argmax())
                if got[i] > self.best[c]:
                    self.best[c], self.pick[c] = got[i], i

    def filling(self, c: int) -> list[int]:
        """Places in ``sizes`` of the dearest filling of ``c``."""
        out = []
        while c > 0:
            i = int(self.pick[c])
            if i < 0:
                c -= 1
            else:
                out.append(i)
                c -= int(self.sizes[i])
        return out


def configuration_lp(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple, float]:
    """Fractional use of configurations, by multiplicative weights.

    The starting price of a length is its share of a sequence, the dual optimum
    of a packing without waste; it falls exponentially while the length gets
    covered.  Each step solves one knapsack and takes, for every length, the
    dearest configuration that holds it, if it is within ``SLACK`` of the
    dearest of all; no count is covered by more than ``STEP`` at once.  The
    solution is scaled so that no length is used beyond its count.
    """
    covered = np.zeros(len(sizes))
    found: Counter = Counter()
    for _ in range(STEPS):
        share = covered / counts
        price = sizes * np.exp(-RATE * (share - share.min()))
        knapsack = Knapsack(price, sizes, capacity)
        worth = price + knapsack.best[capacity - sizes]
        step, added = {}, np.zeros(len(sizes))
        for i in np.flatnonzero(worth >= (1 - SLACK) * worth.max()).tolist():
            config = tuple(sorted([i, *knapsack.filling(capacity - int(sizes[i]))]))
            step[config] = step.get(config, 0) + counts[i] / config.count(i)
        for config, amount in step.items():
            for i in config:
                added[i] += amount
        scale = STEP / (added / counts).max()
        covered += scale * added
        for config, amount in step.items():
            found[config] += scale * amount
    most = (covered / counts).max()
    return {config: amount / most for config, amount in found.items()}


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Fillings of a sequence (piece lengths) and how many sequences use each.

    Together they hold every piece exactly once.  Whole uses of configurations
    without waste are taken from the fractional solution; best fit places the
    rest.
    """
    out = [([capacity], histogram[capacity])] if histogram.get(capacity) else []
    left = {s: n for s, n in histogram.items() if n and s < capacity}
    if left:
        sizes = np.array(sorted(left))
        counts = np.array([left[s] for s in sizes.tolist()])
        for config, amount in configuration_lp(sizes, counts, capacity).items():
            lengths = [int(sizes[i]) for i in config]
            if sum(lengths) == capacity and int(amount):
                out.append((lengths, int(amount)))
                for s in lengths:
                    left[s] -= int(amount)
    return out + best_fit({s: n for s, n in left.items() if n}, capacity)


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing of what rounding left over, equal pieces at a time.

    Sequences filled alike are kept as one group, so the work follows the
    number of lengths and not the number of pieces.
    """
    groups: list[list[tuple[tuple, int]]] = [[] for _ in range(capacity + 1)]
    for size in sorted(left, reverse=True):
        n, moved = left[size], []
        r = size
        while n and r <= capacity:
            while n and groups[r]:
                filling, times = groups[r].pop()
                take = min(n, times)
                if take < times:
                    groups[r].append((filling, times - take))
                # a sequence that this size fills again stays in turn
                moved.append((r - size, (*filling, size), take))
                n -= take
            if moved:
                for room, filling, times in moved:
                    groups[room].append((filling, times))
                # rooms below r may now take the size again
                r, moved = min(size, r), []
                if all(not g for g in groups[size:r + 1]):
                    r += 1
            else:
                r += 1
        fit = capacity // size
        if n >= fit:
            groups[capacity - fit * size].append(((size,) * fit, n // fit))
        if n % fit:
            groups[capacity - n % fit * size].append(((size,) * (n % fit), 1))
    return [(list(f), n) for g in groups for f, n in g]


def runs(fillings: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first place, past last, first sequence, offset)`` of each slot."""
    out, used, sequence = [], Counter(), 0
    for sizes, times in fillings:
        offset = 0
        for size in sizes:
            out.append((size, used[size], used[size] + times, sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """One row per piece with its ids and its place.

    ``doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset``;
    ``ids`` holds little-endian unsigned 32-bit ids.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _cut(tokenizer, end_id, capacity), _PIECE)
    pieces = scratch.put("pieces", cut.withColumn("ids_crc32", F.crc32("ids")))
    counts = scratch.put("counts", pieces.groupBy("part", "length").agg(
        F.count("*").alias("n")))
    histogram = {r.length: r.n for r in
                 counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = runs(plan(histogram, capacity))
    if len(table) > PLAN_LIMIT:
        raise ValueError(f"plan of {len(table)} runs; the bound is {PLAN_LIMIT}")
    places = spark.createDataFrame(
        table, "length long, low long, high long, sequence long, offset long")
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = pieces.join(before, ["part", "length"]).withColumn(
        "place", F.col("place") + F.col("before"))
    return numbered.join(F.broadcast(places), (numbered.length == places.length)
                         & (F.col("place") >= F.col("low"))
                         & (F.col("place") < F.col("high"))).select(
        "doc_id", "piece", "start", numbered.length, "ids", "ids_crc32",
        (F.col("sequence") + F.col("place") - F.col("low")).alias("sequence_id"), "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves: ``sequence_id, n_tokens, ids``.

    A sequence has at most ``capacity`` tokens, so a group is always small.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens",
        F.aggregate("parts", F.lit(b"").cast("binary"),
                    lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
