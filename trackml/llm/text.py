"""Vectorised words and hashes over the bytes of an Arrow string column.

Texts are handled in slices of about a megabyte, whole documents each (a longer
document is a slice of its own), so memory follows the slice and not the batch.
All positions refer to the slice's bytes; a word never crosses a document's
end.  Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20

_MASK = (1 << 64) - 1


def seeds(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit values derived from ``seed``."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xD1B54A32D192ED03)
               + U64(seed * 0x9E3779B97F4A7C15 & _MASK))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.empty(0, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 1 << 16)
            self._up, self._down = (
                np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64))])
                for b in (self.base, self.inverse))
        return self._up[:n], self._down[:n]


_BYTE = seeds(11, 256)
_BYTE_POWERS = Powers(0x9FB21C651E98DF25)
_WORD_POWERS = (Powers(0xC2B2AE3D27D4EB4F), Powers(0xE7037ED1A0B428DB))

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~SPACE
#: letters, digits and every byte of a non-ASCII character
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_lo:_hi] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Slice:
    """Consecutive rows ``lo:hi`` of a column as bytes; ``offsets`` has one more entry."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    """Words of a slice: byte range, hash, and the first word of each document."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices; a null text counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1] \
        if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        yield Slice(lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def words(s: Slice, inside: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of bytes for which ``inside`` holds, document by document."""
    m = inside[s.data]
    cuts = s.offsets[1:-1]
    cuts = cuts[cuts < len(m)]
    before = np.zeros(len(m), bool)
    before[1:] = m[:-1]
    before[cuts] = False
    after = np.zeros(len(m), bool)
    after[:-1] = m[1:]
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, s.offsets))


def word_hashes(s: Slice, w: Words, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word's bytes; ``lower`` folds A-Z only."""
    return range_hashes(LOWER[s.data] if lower else s.data, w.starts, w.ends)


#: bytes from which a range is hashed by itself: sums of powers modulo 2^64 collide for
#: every odd base on patterns of 1,024 symbols (Thue-Morse), so none are taken that long
LONG = 512


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range of ``data``."""
    up, down = _BYTE_POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    out = mix((total[ends] - total[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts >= LONG):
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def content_digests(s: Slice, w: Words) -> np.ndarray:
    """SHA-256 of each document's words joined by one blank, as four 64-bit values a row."""
    edge = np.zeros(len(s.data) + 1, np.int8)
    edge[w.starts] += 1
    edge[w.ends] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    # the byte behind each word but a document's last is white space; it becomes the blank
    last = w.first[1:][w.count() > 0] - 1
    between = np.delete(w.ends, last)
    keep[between] = True
    data = s.data.copy()
    data[between] = 0x20
    data = data[keep]
    stops = np.concatenate([[0], np.cumsum(keep)])[s.offsets] if len(keep) \
        else np.zeros(len(s.offsets), np.int64)
    digests = b"".join(hashlib.sha256(data[a:b].tobytes()).digest()
                       for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True))
    return np.frombuffer(digests, "<i8").reshape(-1, 4)


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each run of consecutive words ``starts:ends``; ``which`` picks one of two.

    For short runs (phrases, windows, shingles) only: see ``LONG``.
    """
    up, down = _WORD_POWERS[which].get(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of word hashes and of its inverse."""
    return _WORD_POWERS[0].get(n)


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n`` consecutive words of one document.

    Returns the hashes and, as in :class:`Words`, the first of each document.
    """
    count = np.maximum(np.diff(first) - n + 1, 0)
    out_first = np.concatenate([[0], np.cumsum(count)])
    starts = np.arange(out_first[-1]) + np.repeat(first[:-1] - out_first[:-1], count)
    return run_hashes(hashes, starts, starts + n), out_first


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges ``starts[i] : starts[i] + lengths[i]``, in order."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)
