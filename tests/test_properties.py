"""Property checks: our replacements agree with the Spark ML components they stand in for."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trackml.operators import indexing, prepare

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

labels = st.lists(st.sampled_from(["a", "b", "B", "é", "z", "aa", "Ω", "𝄞", "x y"]),
                  min_size=1, max_size=40)


@SETTINGS
@given(words=labels)
def test_label_order_equals_string_indexer(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "label string")
    counts = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    assert indexing.label_model_from_counts(counts).labels == \
        indexing.fit_label_indexer(df).labels


values = st.one_of(st.none(), st.just(float("nan")),
                   st.floats(min_value=-1e6, max_value=1e6, allow_nan=False))
rows = st.lists(st.tuples(values, values, values), min_size=1, max_size=25)


@SETTINGS
@given(data=rows)
def test_vectorize_equals_vector_assembler(spark, data):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)],
                               "track_id long, a double, b double, c double")
    packed, names = prepare.pack_features(df)
    for mode in ("skip", "keep"):
        ours = {r.track_id: r.features.toArray().tolist()
                for r in prepare.vectorize(packed, names, handle_invalid=mode).collect()}
        theirs = {r.track_id: r.features.toArray().tolist()
                  for r in prepare.assemble(df, names, handle_invalid=mode,
                                            keep=("track_id",)).collect()}
        assert ours.keys() == theirs.keys()
        for k in ours:
            assert all((math.isnan(x) and math.isnan(y)) or x == y
                       for x, y in zip(ours[k], theirs[k]))
