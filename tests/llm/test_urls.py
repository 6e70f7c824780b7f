"""URL verdicts against SQL and by hand."""

import duckdb
import pytest

from trackml.llm import queries, urls


def test_sf001_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view pages as from '{sf}/pages.parquet'")
    got = {tuple(r) for r in queries.op10_urls(spark, sf).collect()}
    assert got == set(duckdb.sql(queries.SQL["op10_urls"]).fetchall())


CASES = [
    ("http://a.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
    ("http://net", "net", "", None, "allow"),
    ("http://x.notexample.com/de/a", "x.notexample.com", "/de/a", None, "allow"),
    ("https://b.example.com/de/a", "b.example.com", "/de/a", "example.com/de/", "block"),
    ("http://casino.org/fr/", "casino.org", "/fr/", "org/fr/", "allow"),
    ("http://casino.org/en/", "casino.org", "/en/", None, "block"),
    ("http://casinos.org/en/", "casinos.org", "/en/", None, "allow"),
    ("http://h.org/free", "h.org", "/free", None, "allow"),
    ("http://h.org/free/free", "h.org", "/free/free", None, "allow"),
    ("http://h.org/free-poker", "h.org", "/free-poker", None, "block"),
    ("http://h.org?u=x://PORN", "h.org", "", None, "block"),
    ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("http:///p", "", "/p", None, "allow"), ("x" * 100000 + "://h/p", "h", "/p", None, "allow"),
]


@pytest.fixture()
def judged(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)],
                               "page_id long, url string").selectExpr(
        "*", "'x' as host", "1 as path", "2 as strict_hits", "3 as rule")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}


def test_cases(judged):
    for i, (url, *want) in enumerate(CASES):
        assert judged[i] == tuple(want), url


def test_empty_and_repeated(spark):
    schema = "page_id long, url string"
    assert urls.judge(spark.createDataFrame([], schema)).count() == 0
    assert urls.judge(spark.createDataFrame([(None, None), (1, "u"), (1, "u")], schema)).count() == 3


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_no_term_is_a_host_of_the_tables(sf):
    """The vocabulary is not fitted to the pages at hand."""
    hosts = duckdb.sql("select distinct lower(regexp_extract(url, '://([^/?#]*)', 1)) "
                       f"from '/root/testdata/{sf}/pages.parquet' where url is not null").fetchall()
    labels = {part for (h,) in hosts for part in h.split(".")}
    assert not labels & {*urls.STRICT, *urls.SOFT}


def test_other_vocabulary(spark):
    pages = spark.createDataFrame([(1, "http://a.org/casino"), (2, "http://a.org/tulips"),
                                   (3, "http://a.org/rose-oak")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(
        pages, rules=(), strict=("tulips",), soft=("rose", "oak")).collect()}
    assert got == {1: "allow", 2: "block", 3: "block"}
    got = urls.judge(pages, rules=(), strict=("tulips",), soft=("rose", "oak"), soft_limit=3)
    assert {r.page_id: r.verdict for r in got.collect()}[3] == "allow"


def test_query_parameters_are_no_terms(spark):
    pages = spark.createDataFrame([(1, "http://a.org/en/1?page=2&ref=x")],
                                  "page_id long, url string")
    assert urls.judge(pages).first().soft_hits == 0
