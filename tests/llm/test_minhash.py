"""MinHash groups against brute force over all pairs."""

import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, lower_ascii, make_docs
from trackml.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(lower_ascii(text or ""))
    if not w:
        return frozenset()
    if len(w) < k:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, percent):
    """doc_id -> (size, component) over distinct doc_ids."""
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, shingles(t, k))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = {}
    for d, s in sets.items():
        for g in s:
            by_shingle.setdefault(g, []).append(d)
    pairs = {(a, b) for ds in by_shingle.values() for a in ds for b in ds if a < b}
    for a, b in pairs:
        x, y = sets[a], sets[b]
        both = len(x & y)
        if 100 * both >= percent * (len(x) + len(y) - both):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def run(spark, rows, p):
    df = make_docs(spark, rows)
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept)
            for r in minhash.near_duplicates(df, p).collect()}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_sf001_matches_all_pairs(spark, words, percent):
    rows = documents("sf0.001")
    p = minhash.Params(words=words, percent=percent)
    want = {(d, n, c, d == c) for d, (n, c) in brute(rows, words, percent).items()}
    assert run(spark, rows, p) == want


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"),
            (7, "One  two"), (8, "two one"), (9, "É é"), (10, "é é"), (None, "one"),
            (11, "a b c"), (12, "a b c"), (12, "a b c"), (13, "a b c d"), (14, "x " * 3000)]
    p = minhash.Params(words=3, percent=85)
    want = {(d, n, c, d == c) for d, (n, c) in brute(rows, 3, 85).items()} | {(None, 1, None, True)}
    assert run(spark, rows, p) == want


def test_empty_table(spark):
    assert run(spark, [], minhash.Params()) == set()


def test_extra_columns_do_not_clash(spark):
    df = make_docs(spark, [(1, "a b c d e f"), (2, "a b c d e f")])
    for name in ("node", "root", "set_key", "rep", "band", "n", "blocks"):
        df = df.withColumn(name, F.lit("x"))
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1)}


def test_blocks_connect_a_large_family(spark, monkeypatch):
    """A family cut into many blocks gives the same groups as brute force."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(150):
        w = list(base)
        for j in range(d % 11):
            w[(d * 37 + j * 13) % 120] = f"e{d}x{j}"
        rows.append((d, " ".join(w)))
    p = minhash.Params(words=3, percent=85)
    want = {(d, n, c, d == c) for d, (n, c) in brute(rows, 3, 85).items()}
    assert len({c for _, _, c, _ in want}) > 5
    assert run(spark, rows, p) == want


def test_band_count_keeps_the_stated_miss_rate():
    for percent in (80, 85):
        p = minhash.Params(percent=percent)
        assert (1 - (percent / 100) ** p.rows) ** p.bands <= p.miss
