"""Classifiers: held-out quality, defined cases, gradients and invariants."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ROOT, make_docs
from trackml.llm import quality_model, queries, toxicity
from trackml.llm import text as T

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name,label,threshold,least", [
    ("op5_quality", "quality", 0.7, 0.9), ("op6_toxicity", "toxic", 0.3, 0.75)])
def test_held_out(spark, name, label, threshold, least):
    """Documents never learned from are told apart; both rates count."""
    rows = queries.QUERIES[name](spark, f"{ROOT}/sf0.01").collect()
    truth = dict(duckdb.sql(f"select doc_id, {label} from '{ROOT}/sf0.01/labels.parquet'").fetchall())
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    rates = [np.mean([p == c for p, t in held if t == c]) for c in (0, 1)]
    assert np.mean(rates) >= least, rates


@pytest.mark.parametrize("module", [quality_model, toxicity])
def test_defined_cases(spark, module):
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "a b c"), (3, "a b c"),
            (4, "x " * 30000), (5, "!!! ###"), (6, "é" * 10)]
    df = make_docs(spark, rows).withColumn("score", F.lit("x")).withColumn("label", F.lit("x")) \
        .withColumn("fold", F.lit("x")).withColumn("labelled_id", F.lit("x"))
    labels = spark.createDataFrame(
        [(1, 0, 0), (1, 1, 1), (3, 1, 1), (4, 0, 0), (5, None, None), (None, 1, 1), (6, 0, 0)],
        LABELS).withColumn("text", F.lit("x"))
    got = module.score(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False]


@pytest.mark.parametrize("module", [quality_model, toxicity])
def test_no_labels_or_one_class(spark, module):
    df = make_docs(spark, [(1, "a"), (3, "b")])
    empty = spark.createDataFrame([], LABELS)
    assert {r.score for r in module.score(df, empty).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 1), (3, 1, 1)], LABELS)
    assert all(r.score > 0.9 for r in module.score(df, one).collect())
    assert module.score(make_docs(spark, []), empty).count() == 0


def test_word_vectors_do_not_depend_on_slices():
    texts = pa.array(["the cat sat on the mat", "", "THE CAT!!\nTHE CAT!!", "a a a |"])
    totals = []
    for size in (1, 1 << 20):
        total = np.zeros(quality_model.ITEMS * quality_model.DIMS, np.int64)
        for s in T.slices(texts, size):
            quality_model.gather(s, total)
        totals.append(total)
    assert (totals[0] == totals[1]).all() and totals[0].any()


def test_shapes_tell_repeats():
    [s] = T.slices(pa.array(["b a a c\nnew line\nb a a c"]))
    _, shape, _ = quality_model.items(s)
    flags = (shape - quality_model.SPELLINGS) % 4
    assert flags.tolist() == [0, 0, 2, 0, 0, 0, 1, 1, 3, 1]


def test_scores_do_not_depend_on_slices():
    """Filters never reach over a document's end."""
    rng = np.random.default_rng(3)
    model = toxicity.Model()
    model.tables = rng.normal(0, 1, (toxicity.TABLES, toxicity.BUCKETS, toxicity.TAPS)).astype("f4")
    n = len(toxicity.WIDTHS) * toxicity.FILTERS
    model.b, model.w, model.c = np.zeros(n), rng.normal(0, 1, n), np.zeros(1)
    texts = pa.array(["a b c d", "", "the x", "y", "a b"])
    got = [np.concatenate([model.scores(*toxicity.words(s)) for s in T.slices(texts, size)])
           for size in (1, 1 << 20)]
    assert np.allclose(got[0], got[1])


def test_responses_equal_plain_convolution():
    rng = np.random.default_rng(5)
    taps = rng.normal(0, 1, (7, toxicity.TAPS))
    first = np.array([0, 3, 3, 7])
    got = toxicity.responses(taps, first)
    at = 0
    for g, width in enumerate(toxicity.WIDTHS):
        for i in range(7):
            end = 3 if i < 3 else 7
            want = sum(taps[i + j, at + j * 8:at + j * 8 + 8] for j in range(width) if i + j < end)
            assert np.allclose(got[i, g * 8:g * 8 + 8], want)
        at += width * 8


def test_language_from_function_words():
    texts = pa.array(["the cat and the dog is", "der Hund und die Katze ist", "le chat est les",
                      "el perro y los gatos", "zzz", None])
    [s] = T.slices(texts)
    _, hashes, first = toxicity.words(s)
    assert toxicity.language(hashes, first).tolist() == [0, 1, 2, 3, 4, 4]


def test_best_cut_parts_the_classes():
    z, y = np.array([3.0, 2.0, 1.0, 0.0]), np.array([1.0, 1.0, 0.0, 0.0])
    assert toxicity.best_cut(z, y) == 1.5


def test_a_very_long_labelled_text_does_not_end_the_sample(spark):
    from trackml.llm import labelled

    rows = [(i, 10) for i in range(200)] + [(1000 + i, 500) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    got = labelled.within(df, "n", 1500)
    assert {r.n for r in got.collect()} == {10} and got.count() == 150
    again = labelled.within(df.where("n = 10"), "n", 1500)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in again.collect()}
    assert labelled.within(df.limit(0), "n", 5).count() == 0


def test_toxicity_learns_from_every_labelled_document(spark):
    """A word that only labelled documents late in hash order hold is learned, too."""
    order = [r[0] for r in spark.range(1, 12001).orderBy(F.xxhash64("id"), "id").collect()]
    free = [i for i in order if zlib.crc32(str(i).encode()) % 4 != 2][:8800]
    texts, marks = [], []
    for place, i in enumerate(free):
        toxic = place % 2
        word = ("blorb" if place >= 8000 else "foul") if toxic else "fine"
        texts.append((i, f"some plain {word} words here {i % 97}"))
        marks.append((i, 0, toxic))
    asked = [(20001, "some plain blorb words here"), (20002, "some plain fine words here")]
    df, labels = make_docs(spark, texts + asked), spark.createDataFrame(marks, LABELS)
    got = {r.doc_id: r.predicted for r in toxicity.score(df, labels).where("doc_id > 20000").collect()}
    assert got == {20001: 1, 20002: 0}


def test_toxicity_learns_from_very_long_texts_and_any_layout(spark, monkeypatch):
    from trackml.llm.scratch import Scratch

    rows = [(i, f"plain words number {i % 7} " + ("bad bad word" if i % 3 == 0 else "good")) for i in range(400)]
    rows += [(1000 + i, "plain words " * 40000 + "zork") for i in range(4)]
    labels = spark.createDataFrame([(d, 0, int("bad" in t or "zork" in t)) for d, t in rows], LABELS)
    df = make_docs(spark, rows)
    free = [t for d, t in rows if zlib.crc32(str(d).encode()) % 4 != 2]
    found = toxicity.staged(df, labels, "toxic", Scratch(spark, "test"))
    assert sorted(len(r.ids) for r in found.collect()) == sorted(6 * len(t.split()) for t in free)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 100)
    few, many = (toxicity.score(d, labels).orderBy("doc_id").collect()
                 for d in (df.coalesce(1), df.repartition(7)))
    assert few == many and len({r.predicted for r in few}) == 2


def test_peaks_do_not_depend_on_pieces():
    rng = np.random.default_rng(7)
    taps = rng.normal(0, 1, (40, toxicity.TAPS)).astype("f4")
    first = np.array([0, 3, 3, 20, 21, 40])
    r = toxicity.responses(taps, first)
    want = toxicity.largest(r, first)
    for piece in (1, 2, 7, 100):
        top, where = toxicity.peaks(lambda lo, hi: taps[lo:hi], first, piece)
        assert np.allclose(top, want)
        full = np.diff(first) > 0
        assert np.allclose(np.take_along_axis(r, where[full], axis=0), want[full])


def test_counted_logits_give_the_cut_of_the_single_rows():
    z = np.array([2.0, 2.0, 1.0, 1.0, 1.0, 0.0])
    y = np.array([1.0, 1.0, 1.0, 0.0, 0.0, 0.0])
    assert toxicity.best_cut(np.array([2.0, 1.0, 0.0]), np.array([2.0, 1.0, 0.0]),
                             np.array([2.0, 3.0, 1.0])) == toxicity.best_cut(z, y)
