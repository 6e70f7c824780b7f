"""Connected components against union-find."""

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from trackml.llm import graph
from trackml.llm.scratch import Scratch


def union_find(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in root}


@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)).filter(lambda p: p[0] != p[1])))
def test_stars_keep_components(pairs):
    u = np.array([max(p) for p in pairs], np.int64)
    v = np.array([min(p) for p in pairs], np.int64)
    got = dict(zip(*(x.tolist() for x in graph.stars(u, v)), strict=True))
    assert got == {x: r for x, r in union_find(pairs).items() if x != r}


def test_components_of_paths_hubs_and_loose_ends(spark):
    order = np.random.default_rng(5).permutation(400).tolist()
    path = list(zip(order[:300], order[1:301], strict=False))
    hub = [(1000 + i, 5000) for i in range(200)] + [(7000, 1000 + i) for i in range(0, 200, 3)]
    pairs = path + hub + path[:20] + [(9001, 9002)]
    df = spark.createDataFrame(pairs + [(None, 3), (8, None), (9500, 9500)], "a long, b long")
    got = graph.components(Scratch(spark, "test"), "g", df.repartition(7)).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == union_find(pairs)


def test_no_edges(spark):
    df = spark.createDataFrame([], "a long, b long")
    assert graph.components(Scratch(spark, "test"), "g", df).collect() == []
