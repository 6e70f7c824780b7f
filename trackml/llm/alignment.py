"""Alignment of two tokenizers' ids over the same text, and corpus-wide link counts.

A text is encoded as blank plus text by a byte-level BPE (A), and as text by a
sentencepiece model that adds the blank itself (B); added tokens' strings are
plain text.  A token's bytes are its vocabulary entry's.  Where A's and B's
cumulative byte ends meet, both id lists are cut: end-to-index dictionaries are
intersected as sets, and the sorted common keys slice both lists into groups.
Inside a group each A token is linked with every B token whose bytes overlap.

A text is handled in segments of about ``SEGMENT`` characters.  It is cut only
before a blank behind a character that is no white space: A's pre-tokenizer
cuts there, and no B piece holds a blank behind another character, so the ids
are those of the whole text, and the cut is a common end.

An id pair's count is the number of rows (documents) that hold it linked.
Tasks gather rows into blocks of about ``BLOCK_PAIRS`` different pairs per row
together; a block lists its pairs once, with their documents, and the rows
point into that list.  Counts are summed by pair over the blocks' lists, joined
back to the lists, and each block's rows are then read beside their list, so
what a task holds is bounded by its block.

Defined cases: a null or empty text, and one whose joined A or B bytes differ
from blank plus text, has no tokens: zeros and an empty digest.  Rows that
repeat, or share a doc_id, are documents of their own.  A text longer than a
block is a block by itself.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackml.llm import text as T
from trackml.llm.packing import Encoder
from trackml.llm.scratch import Scratch

#: characters after which a long text may be cut
SEGMENT = 1 << 20
#: different pairs of a block's rows, added up
BLOCK_PAIRS = 4_000_000
#: rows of a block at the most, for texts with few pairs
BLOCK_ROWS = 100_000
SHIFT = 32

_CUT = re.compile(r"(?<=\S) ")
_EMPTY = np.empty(0, np.int64)


@dataclass
class Aligned:
    """A segment's or text's counts, groups as text, and its links' pairs."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    pairs: np.ndarray


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers with the bytes and numbers of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = Encoder(path_a)
        tokenizer = self.a.tokenizer
        tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
        bytes_a = {i: added.get(i) or bytes(letters[c] for c in token)
                   for token, i in tokenizer.get_vocab().items()}
        tokens = ([bytes_a.get(i, b"") for i in range(max(bytes_a) + 1)],
                  [self._piece(i) for i in range(self.b.get_piece_size())])
        # all tokens' bytes in a row, with each one's place and size
        self.flat = [np.frombuffer(b"".join(own), np.uint8) for own in tokens]
        self.size = [np.array([len(x) for x in own]) for own in tokens]
        self.place = [np.cumsum(size) - size for size in self.size]
        # decimal ids by what follows them inside a group and at its end
        self.decimal = [(np.array([f"{i}," for i in range(len(own))], object),
                         np.array([f"{i}{last}" for i in range(len(own))], object))
                        for own, last in zip(tokens, "|;", strict=True)]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) \
            else piece.replace("▁", " ").encode()

    def align(self, raw: bytes, ids: tuple[np.ndarray, np.ndarray]) -> Aligned | None:
        """The alignment of A's and B's ids over ``raw``; None if a side's bytes differ."""
        for own, flat, place, size in zip(ids, self.flat, self.place, self.size, strict=True):
            if flat[T.ranges(place[own], size[own])].tobytes() != raw:
                return None
        a, b = ids
        ends = [np.cumsum(size[own]) for own, size in zip(ids, self.size, strict=True)]
        at = [dict(zip(e.tolist(), range(1, len(e) + 1), strict=True)) for e in ends]
        common = sorted(at[0].keys() & at[1].keys())
        # where each group's slices of both lists end, and how long they are
        stop_a, stop_b = (np.fromiter(map(x.__getitem__, common), np.int64, len(common))
                          for x in at)
        n_a, n_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)

        out = np.empty(len(a) + len(b), object)
        for own, n, stop, before, (inside, last) in (
                (a, n_a, stop_a, stop_b - n_b, self.decimal[0]),
                (b, n_b, stop_b, stop_a, self.decimal[1])):
            text = inside[own]
            text[stop - 1] = last[own[stop - 1]]
            out[np.arange(len(own)) + np.repeat(before, n)] = text
        groups = "".join(out.tolist())[:-1]

        # a slice of n and m tokens has n + m - 1 links, one up to each end that either side has
        steps = np.sort(np.concatenate(ends), kind="stable")
        steps = steps[np.diff(steps, append=-1) != 0]
        left, right = (own[np.searchsorted(e, steps)] for own, e in zip(ids, ends, strict=True))
        return Aligned(len(a), len(b), len(common), groups,
                       left.astype(np.int64) << SHIFT | right)

    def texts(self, texts: list[str]) -> list[Aligned | None]:
        """The alignment of each text; None for one without tokens."""
        parts = [segments(t) if t else [] for t in texts]
        found = self._segments([p for own in parts for p in own])
        out = []
        for own in parts:
            got = [next(found) for _ in own]
            out.append(None if not got or None in got else got[0] if len(got) == 1 else Aligned(
                sum(g.n_a for g in got), sum(g.n_b for g in got), sum(g.n_groups for g in got),
                ";".join(g.groups for g in got), np.concatenate([g.pairs for g in got])))
        return out

    def _segments(self, parts: list[str]) -> Iterator[Aligned | None]:
        for s in T.slices(pa.array(parts, pa.large_string())):
            # B adds the leading blank itself
            coded = self.b.encode([p[1:] for p in parts[s.lo:s.hi]], num_threads=1)
            for i, (a, b) in enumerate(zip(self.a.encode(s), coded, strict=True)):
                yield self.align(s.text(i), (a, np.array(b, np.int64)))


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Blank plus text in parts that each start with a blank."""
    text = " " + text
    out, at = [], 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        out.append(text[at:cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def _packed(places: np.ndarray, links: np.ndarray) -> bytes:
    """Rising places and their links, as compressed byte planes."""
    both = np.concatenate([np.diff(places, prepend=0), links]).astype("<u4")
    return pa.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpacked(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), np.uint8)
    both = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(both[:n].astype(np.int64)), both[n:].astype(np.int64)


_SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


_ROW = pa.schema([
    *((c, pa.int64()) for c in ("block", "doc_id", "n_a", "n_b", "n_groups", "n_links")),
    ("groups_sha256", pa.string()), ("n_pairs", pa.int64()), ("links", pa.binary()),
    # the block's list, in its first row
    ("pairs", pa.binary()), ("docs", pa.binary())])


def _block(number: int, rows: list[tuple]) -> pa.RecordBatch:
    """A block's rows, each with the places of its pairs in the block's list."""
    own = [r[5] for r in rows]
    pairs, at, docs = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    stops = np.cumsum([len(p) for p in own])
    packed = [_packed(part, r[6]) for part, r in
              zip(np.split(at, stops[:-1]), rows, strict=True)]
    lists = [[x.astype(np.int64).tobytes()] + [None] * (len(rows) - 1) for x in (pairs, docs)]
    columns = [[number] * len(rows), *([r[i] for r in rows] for i in range(4)),
               [int(r[6].sum()) for r in rows], [r[4] for r in rows], [len(p) for p in own],
               packed, *lists]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)


def _row(doc_id: int | None, found: Aligned | None) -> tuple:
    if found is None:
        return doc_id, 0, 0, 0, "", _EMPTY, _EMPTY
    return (doc_id, found.n_a, found.n_b, found.n_groups,
            hashlib.sha256(found.groups.encode()).hexdigest(),
            *np.unique(found.pairs, return_counts=True))


def _encode(path_a: str, path_b: str):
    def run(batches):
        own = aligner(path_a, path_b)
        # a task's blocks are numbered as its rows come, the same on every attempt
        number = TaskContext.get().partitionId() << SHIFT
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            ids, texts = T.column(batch, "doc_id").to_pylist(), T.column(batch, "text")
            # a slice's texts at a time, so that memory follows the slice and not the batch
            for s in T.slices(texts):
                found = own.texts(texts.slice(s.lo, s.hi - s.lo).to_pylist())
                rows += map(_row, ids[s.lo:s.hi], found)
                size += sum(len(r[5]) for r in rows[-len(found):])
                if size >= BLOCK_PAIRS or len(rows) >= BLOCK_ROWS:
                    yield _block(number, rows)
                    number, rows, size = number + 1, [], 0
        if rows:
            yield _block(number, rows)
    return run


def _lists(batches):
    for batch in batches:
        for block, pairs, docs in zip(T.column(batch, "block").to_pylist(),
                                      T.column(batch, "pairs"), T.column(batch, "docs"),
                                      strict=True):
            found = np.frombuffer(pairs.as_py(), np.int64)
            yield pa.record_batch([
                pa.array(np.full(len(found), block)),
                pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found),
                pa.array(np.frombuffer(docs.as_py(), np.int64))],
                names=["block", "place", "pair", "docs"])


_RESULT = pa.schema([
    ("doc_id", pa.int64()), *((c, pa.int64()) for c in (
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
    ("groups_sha256", pa.string())])


def _score(key, rows: pa.Table, counts: pa.Table) -> pa.Table:
    order = np.argsort(T.column(counts, "place").to_numpy())
    count = T.column(counts, "count").to_numpy()[order]
    best = T.column(counts, "best").to_numpy(zero_copy_only=False)[order]
    n_best, count_sum = [], []
    for raw, n in zip(rows["links"].to_pylist(), rows["n_pairs"].to_pylist(), strict=True):
        at, links = _unpacked(raw, n) if n else (np.empty(0, np.int64),) * 2
        n_best.append(int(links[best[at]].sum()))
        count_sum.append(int((links * count[at]).sum()))
    return rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column(
        "n_best", pa.array(n_best, pa.int64())).append_column(
        "count_sum", pa.array(count_sum, pa.int64())).append_column(
        "groups_sha256", rows["groups_sha256"]).cast(_RESULT)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row.

    ``n_best`` are links whose pair's count is the highest of its A id.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    encoded = scratch.put("encoded", docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _encode(path_a, path_b), _ddl(_ROW)))
    lists = encoded.where("pairs is not null").select("block", "pairs", "docs").mapInArrow(
        _lists, "block long, place int, pair long, docs long")
    counts = scratch.put("counts", lists.groupBy("pair").agg(F.sum("docs").alias("count")))
    a = F.shiftright("pair", SHIFT).alias("a")
    highest = counts.groupBy(a).agg(F.max("count").alias("highest"))
    judged = counts.select(a, "pair", "count").join(highest, "a").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    placed = lists.join(judged, "pair").select("block", "place", "count", "best")
    return encoded.drop("pairs", "docs").groupBy("block").cogroup(
        placed.groupBy("block")).applyInArrow(_score, _ddl(_RESULT))
