"""URL filter: host and path rules, then a weighted vocabulary found by Aho-Corasick.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, with A-Z lower-cased; its path runs from there to ``?`` or ``#``.  A rule
(host, path prefix, verdict) fits its host and all subdomains; the longest rule
that fits decides.  Without a rule one automaton over all vocabulary terms
reads the lower-cased url; a hit counts only between boundaries (the ends of
the url or a character that is neither letter nor digit).  One strict term, or
``soft_limit`` different soft terms, block the url.

Defined cases: a null url or one without ``://`` has an empty host and path and
no rule; a null url holds no term.  Repeated rows are judged each.  Only the id
and url columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackml.llm import text as T

# Vocabulary by subject and language, chosen by hand from words that such sites use
# for themselves; a strict term blocks alone.  ``judge`` takes any other.  Fixed values.
STRICT = (
    # adult
    "bestiality", "blowjob", "camgirl", "camgirls", "escort", "escorts", "gangbang", "hardcore",
    "hentai", "milf", "nsfw", "nude", "nudes", "porn", "porno", "pornos", "pornstar", "redtube",
    "sexcam", "sexcams", "webcams", "xnxx", "xvideos", "xxx",
    "ficken", "nutten", "sexkontakte",
    "salope", "salopes",
    "follar", "putas",
    # gambling, pills, copied software
    "casino", "viagra", "warez")
SOFT = (
    # adult
    "18plus", "adult", "cam", "cams", "dating", "girls", "hot", "sex", "sexy", "teen", "teens",
    "erotik", "singles", "partnersuche", "rencontre", "rencontres", "sexe", "coquine", "citas",
    "sexo", "chicas",
    # gambling
    "bet", "bets", "betting", "bingo", "gamble", "gambling", "jackpot", "lottery", "poker",
    "roulette", "slots", "wetten", "lotto", "spielautomaten", "loterie", "apuestas", "loteria",
    # pills and money
    "cialis", "loan", "loans", "pharma", "pharmacy", "pills", "kredit", "potenzmittel",
    "pilules", "pastillas", "prestamos",
    # lures, adverts, copied software
    "ads", "adserver", "bonus", "cheap", "click", "crack", "cracked", "download", "free", "keygen",
    "prize", "promo", "serial", "spam", "torrent", "torrents", "tracker",
    "gewinnspiel", "gratis", "gratuit")

# Rules: fixed values
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term in soft:
        a.add_word(term, (term, False))
    for term in strict:
        a.add_word(term, (term, True))
    a.make_automaton()
    return a


def hits(url: str, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) \
        -> tuple[set[str], set[str]]:
    """Different strict and soft terms that stand between boundaries."""
    url = url.translate(_FOLD)
    found: tuple[set[str], set[str]] = set(), set()
    for last, (term, is_strict) in automaton(strict, soft).iter(url):
        first = last - len(term) + 1
        if (first == 0 or url[first - 1] not in _WORD) and \
                (last + 1 == len(url) or url[last + 1] not in _WORD):
            found[0 if is_strict else 1].add(term)
    return found


_FOLD = str.maketrans(UPPER, LOWER)
_WORD = frozenset(LOWER + "0123456789")
_COUNTED = ("page_id long, url string, strict_hits int, soft_hits int")


def _count(strict: tuple[str, ...], soft: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            urls = T.column(batch, "url")
            found = [hits(u or "", strict, soft) for u in urls.to_pylist()]
            yield pa.record_batch([
                T.column(batch, "page_id"), urls,
                pa.array([len(f[0]) for f in found], pa.int32()),
                pa.array([len(f[1]) for f in found], pa.int32())],
                names=["page_id", "url", "strict_hits", "soft_hits"])
    return run


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER),
                      F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host_: Column, path_: Column, rules) -> tuple[Column, Column]:
    """Name (host and path together) and verdict of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [((host_ == h) | host_.endswith("." + h)) & path_.startswith(p) for h, p, _ in ordered]
    names = [F.when(f, F.lit(h + p)) for f, (h, p, _) in zip(fits, ordered, strict=True)]
    verdicts = [F.when(f, F.lit(v)) for f, (_, _, v) in zip(fits, ordered, strict=True)]
    return F.coalesce(*names, F.lit(None).cast("string")), \
        F.coalesce(*verdicts, F.lit(None).cast("string"))


def judge(pages: DataFrame, rules=RULES, strict: tuple[str, ...] = STRICT,
          soft: tuple[str, ...] = SOFT, soft_limit: int = 2) -> DataFrame:
    """``page_id, host, path, rule, verdict, strict_hits, soft_hits`` per row."""
    counted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(
        _count(tuple(strict), tuple(soft)), _COUNTED)
    parts = counted.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    bad = (F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_limit)
    return parts.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"),
        "strict_hits", "soft_hits")


def judge_sql(rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = 2) -> str:
    """The same judgement as DuckDB SQL over ``pages``."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def hit(term: str) -> str:
        return f"CAST(regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)') AS INTEGER)"

    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"((host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) "
            f"AND starts_with(path, {quoted(p)}))" for h, p, _ in ordered]
    name = " ".join(f"WHEN {f} THEN {quoted(h + p)}"
                    for f, (h, p, _) in zip(fits, ordered, strict=True))
    verdict = " ".join(f"WHEN {f} THEN {quoted(v)}"
                       for f, (_, _, v) in zip(fits, ordered, strict=True))
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')
           AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
counted AS (
  SELECT *, CAST({" + ".join(hit(t) for t in strict)} AS INTEGER) AS strict_hits,
         CAST({" + ".join(hit(t) for t in soft)} AS INTEGER) AS soft_hits FROM parts)
SELECT page_id, host, path, CASE {name} END AS rule,
       CASE {verdict} WHEN strict_hits > 0 OR soft_hits >= {soft_limit} THEN 'block'
            ELSE 'allow' END AS verdict, strict_hits, soft_hits
FROM counted"""
