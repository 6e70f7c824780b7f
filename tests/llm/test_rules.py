"""Quality rules against SQL and a plain Python count."""

import re
from collections import Counter

import duckdb
import pytest

from tests.llm.helpers import make_docs
from trackml.llm import queries, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_equals_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    duckdb.sql(f"create or replace view documents as from '{sf}/documents.parquet'")
    df = queries.op9_rules(spark, sf)
    want = duckdb.sql(f"select {', '.join(df.columns)} from ({queries.SQL['op9_rules']})")
    assert {tuple(r) for r in df.collect()} == set(want.fetchall())


TEXTS = [None, "", " \n\t", "a", "a b c d e", "a b c d e f a b c d e", "x " * 30, "!!! ###",
         "l1 a\nl1 a\n\n \nl1 a", "a b c d e a b c d e f g h a b c d e", "é è ß|<",
         "the of and to in is that it for was on", "w " * 20000,
         " ".join(f"n{i}" for i in range(20000)), "a\x0bb\x0cc\rd"]


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(wins)
    hit = {i + k for i, x in enumerate(wins) if n[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(hit))


def test_measures_equal_plain_python(spark):
    df = make_docs(spark, list(enumerate(TEXTS))).selectExpr("*", "1 as words", "2 as hashes")
    got = {r.doc_id: tuple(r)[1:6] for r in rules.measures(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_base_and_defined_cases(spark):
    rows = [(1, None), (None, "a"), (2, "a b c d e f g h i"), (2, "a b c d e f g h i"),
            (3, "the of and to in is that it for was on")]
    got = sorted((str(r.doc_id), r.base_failed, r.kept) for r in
                 rules.judge(make_docs(spark, rows)).collect())
    assert got == [("1", True, False), ("2", True, False), ("2", True, False),
                   ("3", False, True), ("None", True, False)]
    assert rules.judge(make_docs(spark, [])).count() == 0


def test_no_python_on_the_path(spark):
    plan = rules.judge(make_docs(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
