"""The pipeline's stages against brute force on a small corpus."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_minhash, test_packing, test_tiling
from tests.llm.helpers import ROOT, make_docs
from trackml.llm import pii, quality_model

SF = f"{ROOT}/sf0.001"


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality_model.score(docs, labels).collect() if r.predicted == 1}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    assert 0 < len(rows) < docs.count()
    groups = test_minhash.brute(rows, 5, 80)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    leaks = test_tiling.brute(rows, items)
    rows = [(d, t) for d, t in rows if not leaks[d][0]]
    texts = {r.doc_id: r.text for r in pii.pseudonymize(make_docs(spark, rows)).collect()}
    test_packing.check(corpus_pipeline.run(spark, SF).collect(), texts, 1024)


def test_stages_take_empty_null_and_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(30))
    df = make_docs(spark, [(1, None), (2, ""), (3, text), (3, text), (4, text), (None, text),
                           (5, "a@b.example.com")]).withColumn("rep", F.lit("x"))
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "best_fit_packing":
                assert out.columns == docs.columns
            out.collect()
    kept = corpus_pipeline.near_dedup(spark, df, SF).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "5", "None"]
    clean = corpus_pipeline.decontamination(spark, df, SF)
    assert clean.count() == df.count()


def test_near_dedup_rows_that_share_an_id(spark):
    """Different texts of one id all stay; equal ones once, the same on every run."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, "en", "z", 1), (2, b, "en", "s2", 2), (2, c, "en", "s1", 3),
            (2, c, "en", "s0", 3), (3, a, "en", "s", 1), (None, a, None, None, None),
            (None, a, None, None, None), (4, None, "en", "s", 0), (4, "", "en", "s", 0)]
    df = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 5):
        out = corpus_pipeline.near_dedup(spark, df.repartition(parts), SF)
        assert out.columns == df.columns
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(
            [rows[0], rows[1], rows[3], rows[5], rows[6], rows[7], rows[8]], key=repr)
