"""Greedy string tiling against a plain version, and planted leaks."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ROOT, documents, lower_ascii, make_docs
from trackml.llm import queries, tiling

TOKEN = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def plain_tiles(a, b, least):
    """Take the longest match of free tokens again and again."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while (i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n]
                       and a[i + n] == b[j + n]):
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return out
        out.append((i, j, n))
        free_a[i:i + n] = [False] * n
        free_b[j:j + n] = [False] * n


def test_tiles_equal_plain_version():
    rng = np.random.default_rng(7)
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(0, 25)).astype(np.uint64) for _ in range(2))
        for least in (1, 2, 4):
            got = tiling.tiles(a, b, least)
            want = plain_tiles(a.tolist(), b.tolist(), least)
            assert sorted(n for *_, n in got) == sorted(n for *_, n in want)


def tokens(text):
    return TOKEN.findall(lower_ascii(text or ""))


def brute(docs, items, least=5, threshold=0.5):
    """doc_id -> (n_items, best item, coverage) without seeds."""
    code, out = {}, {}
    items = [(i, np.array([code.setdefault(w, len(code) + 1) for w in tokens(t)], np.uint64))
             for i, t in items]
    for d, t in docs:
        doc = np.array([code.get(w, 0) for w in tokens(t)], np.uint64)
        found = []
        for i, item in items:
            if len(item) and len(np.intersect1d(item, doc)):
                hit = sum(n for *_, n in tiling.tiles(item, doc, min(least, len(item))))
                if hit >= threshold * len(item):
                    found.append((-hit / len(item), i))
        out[d] = (len({i for _, i in found}), *((found and (min(found)[1], -min(found)[0]))
                                               or (None, 0.0)))
    return out


def test_sf001_equals_brute_force(spark):
    docs = documents("sf0.001")
    items = duckdb.sql(f"select item_id, text from '{ROOT}/sf0.001/benchmark.parquet'").fetchall()
    got = {r.doc_id: (r.n_items, r.item_id, r.coverage)
           for r in queries.op7_tiling(spark, f"{ROOT}/sf0.001").collect()}
    want = brute(docs, items)
    assert got == want
    assert sum(n > 0 for n, *_ in want.values()) >= 2


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"


@pytest.fixture()
def items(spark):
    return spark.createDataFrame(
        [(1, ITEM), (2, "two words"), (3, None), (4, "..."), (5, ITEM)],
        "item_id long, text string").withColumn("doc_id", F.lit(0)).withColumn("seeds", F.lit(1))


def test_planted_cases(spark, items):
    w = ITEM.split()
    rows = [
        (1, f"before {ITEM} after"), (2, ITEM.upper().replace(" ", ", ")),
        (3, " ".join(["x", *w[9:], "y", *w[:9]])), (4, " ".join(w[:8])), (5, " ".join(w[:9])),
        (6, " ".join(reversed(w))), (7, None), (8, ""), (9, "only two words here"),
        (10, "two other words"), (None, ITEM), (11, "pad " * 20000 + ITEM), (12, "x"), (12, ITEM)]
    df = make_docs(spark, rows).withColumn("item_id", F.lit("x")).withColumn("tiles", F.lit(1))
    got = {(r.doc_id, r.contaminated, r.n_items, r.item_id)
           for r in tiling.decontaminate(df, items).collect()}
    assert got == {(1, True, 2, 1), (2, True, 2, 1), (3, True, 2, 1), (4, False, 0, None),
                   (5, True, 2, 1), (6, False, 0, None), (7, False, 0, None), (8, False, 0, None),
                   (9, True, 1, 2), (10, False, 0, None), (None, True, 2, 1), (11, True, 2, 1),
                   (12, True, 2, 1)}


def test_blocks_give_the_same(spark, items, monkeypatch):
    df = make_docs(spark, [(1, ITEM), (2, "two words"), (3, "none")])
    want = sorted(map(tuple, tiling.decontaminate(df, items).collect()))
    monkeypatch.setattr(tiling, "BLOCK_TOKENS", 1)
    assert sorted(map(tuple, tiling.decontaminate(df, items).collect())) == want


def test_empty_tables(spark, items):
    assert tiling.decontaminate(make_docs(spark, []), items).count() == 0
    [row] = tiling.decontaminate(make_docs(spark, [(1, ITEM)]), items.limit(0)).collect()
    assert not row.contaminated


def test_places_equal_plain_version():
    """Not only the lengths: the first of equally long matches is taken."""
    rng = np.random.default_rng(11)
    for _ in range(200):
        a, b = (rng.integers(0, 3, rng.integers(0, 20)).astype(np.uint64) for _ in range(2))
        for least in (1, 2, 3):
            assert tiling.tiles(a, b, least) == plain_tiles(a.tolist(), b.tolist(), least)


def test_small_pair_batches_give_the_same(monkeypatch):
    rng = np.random.default_rng(12)
    cases = [tuple(rng.integers(0, 2, rng.integers(5, 40)).astype(np.uint64) for _ in range(2))
             for _ in range(40)]
    want = [tiling.tiles(a, b, 2) for a, b in cases]
    monkeypatch.setattr(tiling, "PAIRS", 3)
    assert [tiling.tiles(a, b, 2) for a, b in cases] == want


@pytest.mark.parametrize("one,other", [
    (np.zeros(1000), np.zeros(100_000)),
    (np.tile(np.arange(7), 150), np.tile(np.arange(7), 15_000)),
    (np.concatenate([[9, 9, 9, 9, 9, k + 10] for k in range(150)]),
     np.concatenate([[9, 9, 9, 9, 9, k + 1000] for k in range(15_000)]))])
def test_repetitive_texts_stay_small(one, other):
    import time
    import tracemalloc

    tracemalloc.start()
    began = time.thread_time()
    found = tiling.tiles(one.astype(np.uint64), other.astype(np.uint64), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and sum(n for *_, n in found) >= 0.8 * len(one)
    assert peak < 500e6 and time.thread_time() - began < 60


def test_repetitive_document_through_the_query(spark):
    item = "again " * 1000
    docs = make_docs(spark, [(1, "again " * 100_000), (2, "again " * 400 + "and other words")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.coverage) for r in
           tiling.decontaminate(docs, bench).collect()}
    assert got == {1: (True, 1.0), 2: (False, 0.0)}
