"""Indexers (F2-F4, A2, A3)."""

from pyspark.ml.linalg import Vectors

from trackml.operators import indexing


def test_label_order_frequency_then_alpha(spark):
    df = spark.createDataFrame([(x,) for x in "b a c c a d".split()], "label string")
    model = indexing.fit_label_indexer(df)
    assert model.labels == ["a", "c", "b", "d"]
    frame = {r.label: r.idx for r in indexing.label_index_frame(spark, model).collect()}
    assert frame == {"a": 0.0, "c": 1.0, "b": 2.0, "d": 3.0}


def test_decode_roundtrip(spark):
    df = spark.createDataFrame([(x,) for x in "x y y z".split()], "label string")
    model = indexing.fit_label_indexer(df)
    dec = indexing.label_decoder(model, input_col="indexedLabel", output_col="back")
    out = dec.transform(model.transform(df))
    assert all(r.label == r.back for r in out.collect())


def test_category_zero_first(spark):
    rows = [(Vectors.dense([v, float(i)]),) for i, v in enumerate([-1.0, 0.0, 5.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, ["features"])
    model = indexing.fit_feature_indexer(df)
    assert model.categoryMaps[0] == {0.0: 0, -1.0: 1, 2.0: 2, 5.0: 3}
    assert 1 not in model.categoryMaps  # five distinct values → continuous
    cats = indexing.category_frame(spark, model, ["v", "i"]).collect()
    assert [(r.value, r.idx) for r in cats] == [(0.0, 0), (-1.0, 1), (2.0, 2), (5.0, 3)]


def test_label_model_from_counts_equals_fit(spark):
    words = "b a c c a d Zz zz é e a".split()
    df = spark.createDataFrame([(x,) for x in words], "label string")
    fitted = indexing.fit_label_indexer(df).labels
    counts = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    assert indexing.label_model_from_counts(counts).labels == fitted
