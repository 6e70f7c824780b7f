"""Main text against SQL on the pages' own markup, and by hand on other markup."""

import duckdb
import pytest

from trackml.llm import html_text, queries
from trackml.llm.html_text import main_text


def text(page):
    return main_text(page)[0]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    duckdb.sql(f"create or replace view pages as from '{sf}/pages.parquet'")
    df = queries.op11_html_text(spark, sf)
    want = duckdb.sql(f"select {', '.join(df.columns)} from ({queries.SQL['op11_html_text']})")
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


LONG = ("The committee said on Friday that it was going to publish the report for the public, "
        "and that this would be the last of the year.")
ODD = "Quorvex zendral pluthane vrimbol krastid, fendrix gorlamp stivven prandole wexford tramble."

PARTS = {
    "nav": f"<nav><p>{LONG}</p></nav>",
    "header": f"<header><p>{LONG}</p></header>",
    "footer": f"<footer><p>{LONG}</p></footer>",
    "aside": f"<aside><p>{LONG}</p></aside>",
    "form": f"<form><p>{LONG}</p><label>Name</label><select><option>{LONG}</select></form>",
    "script": f"<script>var t='</p><p>{LONG}</p>';if(a<b){{}}</script>",
    "style": f"<style>p{{content:'{LONG}'}}</style>",
    "comment": f"<!-- <p>{LONG}</p> -->",
    "ad": f"<div class='ad'>{LONG}</div>",
    "advert": f"<div id=topAdvert><p>{LONG}</p></div>",
    "cookie": f"<div class='x cookie-notice'><p>{LONG}</p></div>",
    "sidebar": f"<div class=sidebarLeft><p>{LONG}</p></div>",
    "comments": f"<section id='comments'><article><p>{LONG}</p></article></section>",
    "role": f"<div role=navigation><p>{LONG}</p></div>",
    "hidden": f"<div hidden><p>{LONG}</p></div><p style='display: none'>{LONG}</p>",
    "template": f"<template><p>{LONG}</p></template><noscript>{LONG}</noscript>",
    "links": f"<ul><li><a href=/a>{LONG}</a></li></ul>",
}


@pytest.mark.parametrize("name", PARTS)
@pytest.mark.parametrize("frame", [
    "<article>{a}{x}{b}</article>", "{x}<main>{a}{b}</main>{x}", "<body>{x}{a}{b}{x}</body>",
    "<div class='page has-sidebar no-comments'>{x}<div class='post-content'>{a}{x}{b}</div></div>"])
def test_boilerplate_goes_and_text_stays(frame, name):
    a, b = f"<h1>Title</h1><p>{LONG}</p><p>Short.</p>", f"<p>{LONG} Once more.</p>"
    page = frame.format(a=a, b=b, x=PARTS[name])
    assert text(page) == f"Title\n\n{LONG}\n\nShort.\n\n{LONG} Once more."


def test_density_without_marks():
    page = f"<div>{ODD}</div><div>{LONG}</div><div>{LONG}!</div><div>{ODD}</div>"
    assert text(page) == f"{LONG}\n\n{LONG}!"
    # inside the marked article nothing speaks against the odd block but its density
    page = f"<div>{LONG}</div><article><p>{LONG}</p><p>{ODD}</p></article>"
    assert text(page) == f"{LONG}\n\n{ODD}"


def test_short_blocks_follow_their_neighbours():
    menu = "<ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul>"
    page = f"{menu}<p>Near the menu</p>{menu}<p>{LONG}</p><p>Inside</p><p>{LONG}</p>" \
           f"<h2>Heading of the list</h2>{menu}"
    assert text(page) == f"{LONG}\n\nInside\n\n{LONG}"


def test_other_language_and_script():
    other = "Слово о том что было и что будет потом когда все закончится и мы снова пойдём домой вместе."
    assert text(f"<div>{other}</div>") == other
    german = "Der Ausschuss hat am Freitag mit der Arbeit an dem Bericht für das Jahr und die Region begonnen."
    assert text(f"<div>{german}</div>") == german


CASES = [
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("<", ""), ("<article><", "<"),
    ("<article>a&amp;b &lt;i&gt; &#233;&nbsp;&copy; x</article>", "a&b <i> é © x"),
    ("<article>a < b<br>c\n\t d</article>", "a < b c d"),
    ("<article><p>one<p>two<div>three</div>four</article>", "one\n\ntwo\n\nthree\n\nfour"),
    ("<article><p title='>'>quoted</p><p data-x=a>bare</article>", "quoted\n\nbare"),
    ("<article>in<b>li</b>ne <i>mark</i>up</article>", "inline markup"),
    ("<article>cut off <p cla", "cut off"), ("<article>open <!-- never closed", "open"),
    ("<article>a<script>never closed", "a"), ("<article>a</p>b</article>", "a\n\nb"),
    ("<ARTICLE><P>upper</P></ARTICLE>", "upper"),
    ("<article><header><h1>T</h1><p>By A. B.</p></header>x</article>", "T\n\nx"),
    ("<article><table><tr><td>c1<td>c2<tr><td>c3</table></article>", "c1\n\nc2\n\nc3"),
    ("<article>x<textarea><p>y</p></textarea>z</article>", "xz"),
    ("<article class='post category-notices related'>x</article>", "x"),
    ("<main>a<article class='comment even'>b</article></main>", "a"),
    ("<article>a<div class='elementor-widget-container'>b</div><div class='widget x'>c</div>",
     "a\n\nb"),
    ("<article>a<div class='the-social-sciences'>b</div><div class='share-buttons'>c</div>",
     "a\n\nb"),
    ("<form id=all><article>inside a page-wide form</article></form>", "inside a page-wide form"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_cases(page, want):
    assert text(page) == want


@pytest.mark.parametrize("page", [
    "<div>" * 50000, "</div>" * 50000, "<p>" * 50000, "<" * 100000, "<a b='" * 30000,
    "<div><p>x</section>" * 20000, "<!--" * 50000, "&" * 100000, "<li><td><dd>" * 20000,
    "<h1><div>" * 20000 + "x" * 100000, "<a href=x>" * 30000, "=\"" * 50000, "<x =\"" * 20000])
def test_long_odd_pages_end_soon(page):
    import time
    began = time.thread_time()
    main_text(f"<article>{page}")
    assert time.thread_time() - began < 10


def test_table(spark):
    rows = [(1, "u", "<article>a</article>", 5), (1, "u", "<article>a</article>", 6),
            (None, None, None, None), (2, "v", "<p>" + "lorem ipsum the and of " * 40000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int") \
        .selectExpr("*", "'t' as text")
    out = html_text.extract(df)
    assert out.columns[:4] == ["page_id", "url", "text", "n_chars"]
    found = sorted((str(r.page_id), r.url, r.text[:6], r.n_chars) for r in out.collect())
    assert found == sorted([("1", "u", "a", 1), ("1", "u", "a", 1), ("None", None, "", 0),
                            ("2", "v", "lorem ", 40000 * 23 - 1)], key=lambda r: r[0])
    assert html_text.extract(df.limit(0)).collect() == []
