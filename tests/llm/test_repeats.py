"""Removed passages against a plain count of all windows."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, make_docs
from trackml.llm import repeats
from trackml.llm import text as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """(doc_id, n_words, n_removed, kept) of each row, as a sorted list."""
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i:i + window])
                first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i:i + window])] != (d, i):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def run(spark, rows, window=20):
    df = make_docs(spark, rows)
    for name in ("phrases", "text_key", "marks", "start", "n_words"):
        df = df.withColumn(name, F.lit("x"))
    return sorted((tuple(r) for r in repeats.remove_repeats(df, window).collect()), key=str)


def test_sf001_equals_brute_force(spark):
    rows = documents("sf0.001")
    assert run(spark, rows) == brute(rows, 20)


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_small_vocabulary(spark, window, monkeypatch):
    """Few words make windows repeat everywhere, within and across documents."""
    monkeypatch.setattr(repeats, "SHARD_BYTES", 300)
    rng = np.random.default_rng(window)
    rows = [(d, " ".join(rng.choice(list("abcd"), rng.integers(0, 30)))) for d in range(40)]
    assert run(spark, rows, window) == brute(rows, window)


def test_edge_cases(spark):
    p = " ".join(f"p{i}" for i in range(25))
    rows = [(1, None), (2, ""), (3, " \n"), (4, p), (5, p.replace(" ", "\t")), (6, f"x {p} y"),
            (6, f"x {p} y"), (7, f"{p} {p}"), (None, p), (None, p), (8, p.upper()),
            (9, "é " * 60), (10, "a " * 5000), (11, f"q {p[4:]}"), (12, p + "z")]
    assert run(spark, rows) == brute(rows, 20)


def test_rows_sharing_a_doc_id(spark):
    p = " ".join(f"p{i}" for i in range(25))
    rows = [(1, f"a {p}"), (1, p), (2, "b"), (2, p)]
    assert run(spark, rows) == brute(rows, 20)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_automaton_finds_every_occurrence():
    [s] = T.slices(pa.array(["a b c a b", "b c a b c", "x", ""]))
    scan = repeats.Scan(s, 3, 2)
    machine = repeats.Automaton(scan.phrases[:1])
    machine.learn(scan)
    machine.compile()
    found = [machine.located(scan.word_list(i), int(scan.first[i + 1] - scan.first[i])).tolist()
             for i in range(4)]
    assert found == [[True, False, False, True], [False, False, True, False], [], []]


def morse(n, one, other):
    """The first n signs of the Thue-Morse sequence, whose sums of odd powers cancel."""
    return [one if bin(i).count("1") % 2 else other for i in range(n)]


def test_texts_with_colliding_power_sums_are_no_copies(spark):
    """Word by word the two texts differ by the sign of the sequence alone."""
    a, b = ([f"r{i} {w}" for i, w in enumerate(morse(2048, x, y))]
            for x, y in (("yes", "no"), ("no", "yes")))
    assert [r[2] for r in run(spark, [(1, " ".join(a)), (2, " ".join(b))])] == [0, 0]
    # the same within words: bytes in the order of the sequence and its opposite
    x, y = ("".join(morse(4096, *p)) for p in ("ab", "ba"))
    rows = [(1, " ".join([x] * 5 + [f"n{i}" for i in range(15)])),
            (2, " ".join([y] * 5 + [f"n{i}" for i in range(15)]))]
    assert run(spark, rows) == brute(rows, 20)


def test_content_digests():
    import hashlib

    texts = ["", " ", "a", " a  b\tc\n", "x" * 2000, "é ü\x0bz ", "a b c", None]
    for size in (1, 8, 1 << 20):
        got = []
        for s in T.slices(pa.array(texts, pa.string()), size):
            got += T.content_digests(s, T.words(s)).tobytes().hex(" ", 32).split()
        assert got == [hashlib.sha256(" ".join(WORD.findall(t or "")).encode()).hexdigest()
                       for t in texts]
