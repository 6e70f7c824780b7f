"""Main text of web pages: two passes of rules over the page's blocks.

A page is read once: tags end blocks, white space inside a block becomes one
space, character references are decoded, and text of scripts, styles, titles,
templates and form controls is skipped.  Each block keeps its length, its
characters inside links, whether it is a heading, and its surroundings: inside
a boilerplate element (menu, header, footer, sidebar, notice, advert, form,
reader comments; by element, role or class and id words, or hidden) and inside
the page's marked article.  Headings in the article's own header are text.

First pass.  A block is bad inside boilerplate, outside the article of a page
that marks one (``article``, else ``main``, else a class or id that says so),
or where links hold most of it.  A long block is good when its stop-word
density is high (words of the page's own language, the one with most hits),
and bad when it is low on a page without a marked article.  All others are
undecided: short blocks, and those of middling density.

Second pass.  An undecided block takes the label of the nearest decided
neighbours: the one both share, else the nearer one's, good on a tie; a heading
asks the block after it first.  Inside a marked article only decided blocks of
the article count as neighbours, and without any the block is good; so is the
article's first-level heading.

Defined cases: a null or empty page has an empty text, as has one without
blocks.  A page cut off inside a tag or comment ends there.  A page in none of
the languages is judged by length and links alone.  Rows that repeat are read
each.  Only the id, url and html columns are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackml.llm import text as T

# Function words by language: fixed values
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be by at this from or an have not "
          "but they which you their",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch "
          "es an er sie aus bei nach",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur se ne ce "
          "il avec son sont aux",
    "es": "el la los las de del y a en que un una por con no su para es al lo como más pero sus "
          "se o este sí",
}
_STOPS = {lang: frozenset(words.split()) for lang, words in STOP_WORDS.items()}


@dataclass(frozen=True)
class Rules:
    """Thresholds: lengths in code points, densities as shares."""

    short: int = 70
    stop_high: float = 0.15
    stop_low: float = 0.08
    links_short: float = 0.5
    links_long: float = 0.33
    #: least share of words that a language's stop words take on a page
    language: float = 0.04


# Elements: fixed values
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: text up to the end tag is no markup; never shown as text of the page
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
SKIPPED = frozenset("noscript template svg math object head select datalist button canvas audio "
                    "video".split())
#: an open element that the start of one of the second ends, unless one of the third is between
CLOSED_BY = {"p": (BLOCK, ()), "li": ({"li"}, ("ul", "ol", "menu")),
             "dt": ({"dt", "dd"}, ("dl",)), "dd": ({"dt", "dd"}, ("dl",)),
             "td": ({"td", "th", "tr", "tbody", "tfoot"}, ("table",)),
             "th": ({"td", "th", "tr", "tbody", "tfoot"}, ("table",)),
             "tr": ({"tr", "tbody", "tfoot"}, ("table",)),
             "head": (BLOCK - {"html"}, ())}
#: boilerplate whatever stands in it, and boilerplate unless an article starts inside
AROUND = frozenset("nav aside footer menu dialog".split())
AROUND_WEAK = frozenset("form header search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog "
                  "dialog menu menubar toolbar".split())
# Words of classes and ids, and their beginnings: fixed values
NAMES = frozenset("ad ads banner consent dialog disqus footer gdpr legal login masthead menu modal "
                  "nav navigation notice notices notification notifications overlay pager "
                  "pagination paywall popup promo promos promotion recommended related replies "
                  "respond share sharing signup skip social subscribe subscription teaser toolbar "
                  "topbar".split())
#: ... and one that counts as the first word only, as page builders use it for all they build
FIRST = frozenset("widget widgets".split())
STEMS = ("adsbox", "advert", "breadcrumb", "comment", "cookie", "copyright", "disclaimer", "navbar",
         "newsletter", "sidebar", "sponsor")
#: first words of names that tell what a container is like and not what it is
LIKE = frozenset("has no not with without is".split())
CONTENT = frozenset("article articlebody content entry maincontent post story".split())

_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?""")
_CAMEL = re.compile(r"([a-z])([A-Z])")


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """``("text", text, {})``, ``("open", tag, attributes)`` and ``("close", tag, {})``, in order."""
    at, text, end = 0, 0, len(page)
    while True:
        at = page.find("<", at)
        after = page[at + 1:at + 2] if at >= 0 else ""
        if at >= 0 and not (after in "!?/" and after or after.isascii() and after.isalpha()):
            at += 1
            continue
        if at < 0 or (after == "/" and at + 2 >= end):
            break
        if at > text:
            yield "text", page[text:at], {}
        if after in "!?" or after == "/" and not page[at + 2].isalpha():
            if page.startswith("<!--", at):
                close = page.find("-->", at + 2)
                at = close + 3 if close >= 0 else end
            else:
                close = page.find(">", at)
                at = close + 1 if close >= 0 else end
            text = at
            continue
        closing = after == "/"
        name = _NAME.match(page, at + 1 + closing)
        tag, at = name[0].lower(), name.end()
        attributes: dict[str, str] = {}
        while at < end and page[at] != ">":
            found = _ATTRIBUTE.match(page, at)
            if not found:
                # a blank or slash before the bracket, a stray sign, or an open quote
                at += 1
                continue
            if found[2] is None and page.startswith(("=\"", "='"), found.end()):
                at = end
                break
            attributes.setdefault(found[1].lower(), (found[2] or "").strip("\"'"))
            at = found.end()
        if at >= end:
            return
        at = text = at + 1
        if closing:
            yield "close", tag, {}
            continue
        yield "open", tag, attributes
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            if not close:
                return
            at = text = close.start()
    if text < end:
        yield "text", page[text:], {}


def names(attributes: dict[str, str]) -> Iterator[list[str]]:
    """The words of each class and of the id."""
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        yield [w.lower() for w in re.split(r"[^A-Za-z]+", _CAMEL.sub(r"\1 \2", name)) if w]


def surroundings(tag: str, attributes: dict[str, str]) -> int:
    """2 for an element that is boilerplate, 1 unless an article starts inside, else 0."""
    if not attributes:
        return 2 if tag in AROUND else int(tag in AROUND_WEAK)
    style = attributes.get("style", "").replace(" ", "").lower()
    if tag in ("html", "body"):
        return 0
    if tag in AROUND or "hidden" in attributes or "display:none" in style \
            or "visibility:hidden" in style or attributes.get("aria-hidden", "").lower() == "true":
        return 2
    words = [w for w in names(attributes) if w and w[0] not in LIKE]
    if marks(tag, attributes) >= 2:
        # an article's classes tell its subject; only a comment is told by them
        return 2 if any(w[0].startswith("comment") for w in words) else 0
    if any(x.startswith("comment") for w in words for x in w):
        return 2
    if tag in AROUND_WEAK or attributes.get("role", "").lower() in ROLES or any(
            w[0] in NAMES or w[-1] in NAMES or w[0] in FIRST
            or any(x.startswith(STEMS) for x in w) for w in words):
        return 1
    return 0


def marks(tag: str, attributes: dict[str, str]) -> int:
    """How surely an element marks the article: 3 to 1, 0 for none."""
    if tag == "article" or attributes.get("itemprop", "").lower() == "articlebody":
        return 3
    role = attributes.get("role", "").lower()
    if tag == "main" or role in ("main", "article"):
        return 2
    return int(tag in ("div", "section") and any(w and w[-1] in CONTENT for w in names(attributes)))


@dataclass
class Block:
    text: str
    linked: int
    heading: str
    boilerplate: bool
    mark: int
    label: str = ""


@dataclass
class _Open:
    tag: str
    boilerplate: int
    mark: int
    skipped: bool
    heading: str
    #: inside the article's own header, of which headings are text
    titled: bool = False


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    stack: list[_Open] = [_Open("", 0, 0, False, "")]
    count: Counter[str] = Counter()
    parts: list[tuple[str, bool]] = []
    link = 0

    def finish() -> None:
        if not parts:
            return
        top = stack[-1]
        text = " ".join(entities.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = sum(len("".join(entities.unescape(p).split())) for p, inside in parts if inside)
            out.append(Block(text, linked, top.heading, top.boilerplate > 0, top.mark))
        parts.clear()

    def leave(depth: int) -> None:
        nonlocal link
        count.subtract(o.tag for o in stack[depth:])
        del stack[depth:]
        link = min(link, depth)

    for kind, value, attributes in tokens(page):
        if kind == "text":
            if not stack[-1].skipped:
                parts.append((value, link > 0))
            continue
        if kind == "close":
            if value == "a":
                link = 0
            elif value in BLOCK or value in SKIPPED:
                if value in BLOCK:
                    finish()
                # looked for only where one is open, so the steps are those of what it closes
                if count[value] > 0:
                    finish()
                    leave(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == value))
            elif value == "br":
                parts.append((" ", False))
            continue
        if value == "a":
            link = len(stack)
        elif value == "br":
            parts.append((" ", False))
        if value in BLOCK:
            finish()
            for i in range(len(stack) - 1, 0, -1):
                enders, stops = CLOSED_BY.get(stack[i].tag, ((), ()))
                if value in enders:
                    leave(i)
                elif stack[i].tag in stops or stack[i].tag not in CLOSED_BY:
                    break
        if value in VOID or value in RAW or not (value in BLOCK or value in SKIPPED):
            continue
        above = stack[-1]
        mark = marks(value, attributes)
        around = surroundings(value, attributes)
        titled = above.titled or value == "header" and above.mark >= 2 and not above.boilerplate
        outer = above.boilerplate
        if outer == 1 and around == 0 and (mark >= 2 or titled and value in HEADINGS):
            outer = 0
        count[value] += 1
        stack.append(_Open(value, max(outer, around), max(above.mark, mark),
                           above.skipped or value in SKIPPED,
                           value if value in HEADINGS else above.heading, titled))
    finish()
    return out


def page_language(words: list[list[str]], least: float) -> frozenset[str] | None:
    """Stop words of the language with most hits, or None below the least share of all words."""
    counts = Counter(chain.from_iterable(words))
    hits = {lang: sum(counts[w] for w in stops) for lang, stops in _STOPS.items()}
    lang = max(hits, key=lambda x: (hits[x], x))
    return _STOPS[lang] if hits[lang] >= least * max(counts.total(), 1) else None


def judge(page_blocks: list[Block], rules: Rules = Rules()) -> list[Block]:
    """The same blocks with their labels, ``good``, ``bad`` or ``out`` (bad by its place)."""
    words = [_WORD.findall(b.text.lower()) for b in page_blocks]
    stops = page_language(words, rules.language)
    zone = max((b.mark for b in page_blocks if not b.boilerplate), default=0)

    for b, own in zip(page_blocks, words, strict=True):
        if b.boilerplate or b.mark < zone:
            b.label = "out"
            continue
        length = len(b.text)
        links = b.linked / (length - b.text.count(" "))
        short = length < rules.short
        density = 1.0 if stops is None else \
            0.0 if short or not own else sum(map(stops.__contains__, own)) / len(own)
        dense = density >= rules.stop_high
        if b.heading == "h1" and zone and links <= rules.links_short:
            b.label = "good"
        elif links > (rules.links_short if short or dense else rules.links_long):
            b.label = "bad"
        elif short:
            b.label = "bad" if not zone and "\u00a9" in b.text else ""
        elif dense:
            b.label = "good"
        elif density < rules.stop_low and not zone:
            b.label = "bad"

    decided = [i for i, b in enumerate(page_blocks)
               if b.label in (("good", "bad") if zone else ("good", "bad", "out"))]
    inherited = {}
    k = 0
    for i, b in enumerate(page_blocks):
        while k < len(decided) and decided[k] < i:
            k += 1
        if b.label:
            continue
        before = decided[k - 1] if k else None
        after = decided[k] if k < len(decided) else None
        label = {j: "good" if page_blocks[j].label == "good" else "bad"
                 for j in (before, after) if j is not None}
        if not label:
            inherited[i] = "good" if zone else "bad"
        elif b.heading and after is not None:
            inherited[i] = label[after]
        elif before is None or after is None or label[before] == label[after]:
            inherited[i] = next(iter(label.values()))
        elif i - before == after - i:
            inherited[i] = "good"
        else:
            inherited[i] = label[before if i - before < after - i else after]
    for i, value in inherited.items():
        page_blocks[i].label = value
    return page_blocks


def main_text(page: str | None, rules: Rules = Rules()) -> tuple[str, int, int]:
    """Text of the good blocks, their number, and the number of all blocks."""
    judged = judge(blocks(page or ""), rules)
    good = [b.text for b in judged if b.label == "good"]
    return "\n\n".join(good), len(good), len(judged)


_TEXT = "page_id long, url string, text string, n_chars long, n_good long, n_blocks long"


def _extract(rules: Rules):
    def run(batches):
        for batch in batches:
            found = [main_text(p.as_py(), rules) for p in T.column(batch, "html")]
            texts = [f[0] for f in found]
            yield pa.record_batch([
                T.column(batch, "page_id"), T.column(batch, "url"), pa.array(texts, pa.string()),
                *(pa.array(n, pa.int64()) for n in (
                    [len(t) for t in texts], [f[1] for f in found], [f[2] for f in found]))],
                names=["page_id", "url", "text", "n_chars", "n_good", "n_blocks"])
    return run


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``page_id, url, text, n_chars, n_good, n_blocks`` per row, each page by itself."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        _extract(rules), _TEXT)
