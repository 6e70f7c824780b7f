"""Packing: exact token ids, gapless places, every piece once, few sequences."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import documents, make_docs
from trackml.llm import packing
from trackml.llm import text as T
from trackml.llm.queries import tokenizer_path

EDGE = ["", " ", "a", "don't stop it's we'll", "two  blanks", " lead", "trail ", "tab\tand\nline",
        "nbsp\u00a0here", "日本語 text", "Äpfel×÷ÖÜß", "x<|endoftext|>y", "!!! ??", "a\r\nb",
        "1234 56a7", "\n\n", "é" * 3000, "a,b;c 12.5%", "\x00\x1f", "😀 smile", "end\n"]


def whole(text):
    return packing.encoder(tokenizer_path()).tokenizer.encode(
        text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("texts", [EDGE, [t for _, t in documents("sf0.001")]])
def test_ids_equal_the_tokenizers(texts):
    enc = packing.Encoder(tokenizer_path())
    got = [list(ids) for s in T.slices(pa.array(texts, pa.string()), 5000) for ids in enc.encode(s)]
    assert got == [whole(t) for t in texts]


def test_cache_overflow_keeps_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 50)
    texts = [t for _, t in documents("sf0.001")][:40]
    enc = packing.Encoder(tokenizer_path())
    got = [list(ids) for s in T.slices(pa.array(texts), 20000) for ids in enc.encode(s)]
    assert got == [whole(t) for t in texts]


def check(rows, texts, capacity):
    """Pieces hold each document in order; sequences are gapless and within capacity."""
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(r.ids)
    for doc_id, text in texts.items():
        ids = whole(text) + [2]
        own = sorted(pieces.pop(doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(math.ceil(len(ids) / capacity)))
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert all(r.length == capacity for r in own[1:])
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == ids
    assert not pieces
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_pack_round_trip(spark):
    texts = dict(documents("sf0.001"))
    rows = packing.pack(make_docs(spark, list(texts.items())), tokenizer_path()).collect()
    check(rows, texts, 1024)
    tokens = sum(r.length for r in rows)
    used = len({r.sequence_id for r in rows})
    assert used <= max(1.02 * tokens / 1024, sum(r.length > 512 for r in rows)) + 1


def test_edge_cases(spark):
    texts = {i: t for i, t in enumerate([None, *EDGE, "w " * 9000])}
    df = make_docs(spark, list(texts.items()))
    for name in ("ids", "length", "part", "place", "low", "piece"):
        df = df.selectExpr("*", f"'x' as {name}")
    check(packing.pack(df, tokenizer_path(), capacity=16).collect(), texts, 16)


def test_empty_repeated_and_null_ids(spark):
    assert packing.pack(make_docs(spark, []), tokenizer_path()).count() == 0
    rows = packing.pack(make_docs(spark, [(1, "a"), (1, "a"), (None, "b")]),
                        tokenizer_path()).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 2), ("1", 2), ("None", 2)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3


def test_sequences_hold_their_pieces(spark):
    packed = packing.pack(make_docs(spark, [(1, "a b c"), (2, "d"), (3, "e f")]),
                          tokenizer_path(), capacity=64)
    [row] = packing.sequences(packed).collect()
    ids = {tuple(whole(t) + [2]) for t in ("a b c", "d", "e f")}
    got = np.frombuffer(bytes(row.ids), "<u4").tolist()
    assert row.n_tokens == len(got) == sum(map(len, ids))
    cuts = [i + 1 for i, t in enumerate(got) if t == 2]
    assert {tuple(got[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)} == ids


@pytest.mark.parametrize("scale", [1, 1000])
def test_plan_is_near_the_lower_bound(scale):
    lengths = np.random.default_rng(3).integers(1, 1024, 5000).tolist()
    histogram = {k: scale * v for k, v in Counter(lengths).items()} | {1024: 7}
    fillings = packing.plan(histogram, 1024)
    got = Counter()
    for sizes, times in fillings:
        assert sum(sizes) <= 1024
        for s in sizes:
            got[s] += times
    assert got == histogram
    bound = sum(s * n for s, n in histogram.items()) / 1024
    assert sum(n for _, n in fillings) <= 1.01 * bound + 1


@pytest.mark.parametrize("histogram", [{}, {5: 3}, {9: 1}, {1: 100}, {10: 4}, {6: 10}])
def test_plan_of_few_lengths(histogram):
    got = Counter()
    for sizes, times in packing.plan(histogram, 10):
        assert sum(sizes) <= 10
        for s in sizes:
            got[s] += times
    assert got == histogram


def test_best_fit_equals_piecewise():
    """Placing equal pieces at once uses as many sequences as one at a time."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        left = dict(Counter(rng.integers(1, 40, 200).tolist()))
        rooms = []
        for size in sorted((s for s, n in left.items() for _ in range(n)), reverse=True):
            fit = [r for r in rooms if r >= size]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - size)
            else:
                rooms.append(40 - size)
        assert sum(n for _, n in packing.best_fit(left, 40)) == len(rooms)
