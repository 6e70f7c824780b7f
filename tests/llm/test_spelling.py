"""Spelling variants against a plain version that compares through deletion neighbours."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import documents, lower_ascii, make_docs
from trackml.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in map(lower_ascii, RUN.findall(text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 5:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    n = plain_counts(rows)
    # any two near words share a word with at most one letter deleted
    bucket = defaultdict(set)
    for w in n:
        for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            bucket[v].add(w)
    near = defaultdict(set)
    for group in bucket.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None)
            for w in n}


def got(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_plain_on_documents(spark, sf):
    want = plain(documents(sf))
    assert any(w[1] and w[2] != w[1] for w in want)
    assert got(queries.op12_spelling(spark, f"/root/testdata/{sf}")) == want


def test_traps_equal_plain(spark):
    words = {
        "house": 40, "houses": 18, "hosue": 5, "hous": 9, "housse": 9, "mouse": 20, "moose": 10,
        "noose": 5, "loose": 5, "aaaaa": 4, "aaaaaa": 9, "a" * 3000: 3, "a" * 3001: 7,
        "÷×÷×÷": 3, "÷×÷×÷÷": 6, "écolé": 3, "école": 6, "ÉCOLE": 4, "Straße": 8, "strasse": 8,
        "straßen": 3, "tied": 9, "tieda": 3, "tiedb": 6, "tiedc": 6, "tiedab": 3}
    rows = [(None, None), (1, ""), (2, "123 _-"), (None, "house " * 3), (7, "house1house_house")]
    for k, (w, n) in enumerate(sorted(words.items())):
        rows.append((100 + k, f" {w}," * n))
    rows += [(100, "again again again"), (100, "again again again")]
    docs = make_docs(spark, rows).selectExpr("*", "1 as word", "2 as n", "'x' as sig")
    assert got(spelling.variants(docs.repartition(3))) == plain(rows)


def test_slips_delete_one_letter():
    # of many ids some make 97 divide the hash; there the run loses one letter
    hit = [d for d in range(400) if zlib.crc32(f"{d}:spelling".encode()) % 97 == 0]
    assert hit
    for d in hit:
        at = zlib.crc32(f"{d}:spelling".encode()) % 8
        assert spelling.counted(str(d), "Spelling SPELLING") == {
            "spelling"[:at] + "spelling"[at + 1:]: 2}


@pytest.mark.parametrize("parts", [3, 4, 6])
def test_near_words_share_a_signature(spark, parts):
    words = ["house", "houses", "hose", "mouse", "ouseh", "hause", "housee", "shouse"]
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    part = spelling.deal(df, parts)
    assert set(part.values()) <= set(range(parts))
    scratch = spelling.Scratch(spark, "test")
    pairs = spelling.near_pairs(scratch, df, spelling.Params(parts=parts)).collect()
    want = {tuple(sorted((a, b))) for a in words for b in words if one_edit(a, b)}
    assert {tuple(sorted((r.left, r.right))) for r in pairs} == want and len(pairs) == len(want)


def test_no_words(spark):
    assert spelling.variants(make_docs(spark, [])).collect() == []
    assert got(spelling.variants(make_docs(spark, [(1, "alone " * 3)]))) == {
        ("alone", None, "alone", 3, 0, None)}
