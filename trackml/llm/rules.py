"""Quality rules: a threshold table compiled into one projection, without user functions.

Words are maximal runs of what is not a blank or control space
(``[^\\x20\\x09-\\x0D]+``).  Measures of a text:

* ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters
  of ``#*$%&|<>``);
* ``n_lines`` (lines with a word) and ``n_dup_lines`` (those equal to an
  earlier line);
* ``n_stop_words`` (lower-case function words of four languages),
  ``n_same_words`` (words equal to the word before), ``n_bangs`` (exclamation
  marks);
* ``n_repeat_words``: words in five-word windows found twice or more in the
  text, the first occurrence included.  Windows compare by 64-bit hashes; only
  texts in which a hash repeats sort theirs to find the repeats, so the work is
  n log n for any text.

``TABLE`` gives each rule a numerator, a denominator and the allowed range of
their ratio; a ratio without denominator (no word, no line) passes.  One is
added to the stop words, so that a short text may do without any.

Defined cases: a null text counts as empty; no words fail the base.  Repeated
rows are judged each.  Only doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Function words by language: fixed values
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by at this from or an have not but",
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es",
    "de la le et les des en un du une que est pour qui dans par plus pas au sur se ne ce il",
    "el los las del y a por con no su para es al lo como más pero sus o este sí",
)

# (rule, numerator, denominator, least, most)
TABLE = (
    ("word_length", "word_chars", "n_words", 2.0, 12.0),
    ("symbols", "n_symbols", "n_words", 0.0, 0.1),
    ("bangs", "n_bangs", "n_words", 0.0, 0.2),
    ("stop_words", "n_stop_words + 1", "n_words", 0.02, 2.0),
    ("dup_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
    ("same_words", "n_same_words", "n_words", 0.0, 0.3),
    ("repeats", "n_repeat_words", "n_words", 0.0, 0.2),
)

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 5


def _without(col: Column, chars: str) -> Column:
    return F.length(F.translate(col, chars, ""))


def _repeated_words(hashes: str) -> Column:
    """Words covered by windows whose hash occurs twice in the array column ``hashes``.

    Sorting (hash, place) pairs brings equal windows together; places with an
    equal neighbour are put in order again, and each covers up to the next.
    """
    h = F.col(hashes)
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    # a one-element array binds a value that the inner function reads often
    equal = F.transform(F.array(pairs), lambda p: F.sort_array(F.transform(F.filter(
        p, lambda x, j: F.coalesce(x["h"] == F.get(p, j - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get(p, j + 1)["h"], F.lit(False))), lambda x: x["i"])))
    covered = F.transform(equal, lambda s: F.aggregate(
        F.transform(s, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(
            F.get(s, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(F.get(covered, F.lit(0)))


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measures of each text."""
    stop = sorted({w for line in STOP_WORDS for w in line.split()})
    text = F.coalesce("text", F.lit(""))
    parts = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: _without(x, SPACES) > 0).alias("lines"))
    hashed = parts.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    places = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(0), F.size("words") - WINDOW)) \
        .otherwise(F.array().cast("array<int>"))
    windows = hashed.select("*", F.transform(places, lambda i: F.xxhash64(
        *[F.get("hashes", i + k) for k in range(WINDOW)])).alias("windows"))
    return windows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("words").cast("long").alias("n_words"),
        _without(F.col("text"), SPACES).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words("windows").cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        F.size(F.filter("hashes", lambda h, i: F.coalesce(
            h == F.get("hashes", i - 1), F.lit(False)))).cast("long").alias("n_same_words"),
        (F.length("text") - _without(F.col("text"), "!")).cast("long").alias("n_bangs"))


def passes(table=TABLE) -> Column:
    """The rule table as one condition."""
    rules = [F.when(F.col(den) == 0, True).otherwise(
        (F.expr(num) >= F.col(den) * least) & (F.expr(num) <= F.col(den) * most))
        for _, num, den, least, most in table]
    return reduce(lambda a, b: a & b, rules)


def judge(docs: DataFrame, table=TABLE) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every row."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs).withColumn("base_failed", base).withColumn(
        "kept", ~F.col("base_failed") & passes(table))


def judge_sql(table=TABLE) -> str:
    """The same judgement as DuckDB SQL over ``documents``."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for s in STOP_WORDS for w in s.split()}))
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    rules = " AND ".join(
        f"({den} = 0 OR ({num} >= {den} * CAST({least} AS DOUBLE) "
        f"AND {num} <= {den} * CAST({most} AS DOUBLE)))" for _, num, den, least, most in table)
    return f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(text, chr(10)),
                     lambda x: length(translate(x, {space}, '')) > 0) AS lines FROM d),
windows AS (
  SELECT r, i, list_slice(words, i, i + 4) AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
again AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n
  FROM (SELECT r, i, unnest(range(0, 5)) AS k FROM again WHERE n >= 2) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(translate(text, {space}, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_filter(words, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words,
         CAST(len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1]))
              AS BIGINT) AS n_same_words,
         CAST(length(text) - length(translate(text, '!', '')) AS BIGINT) AS n_bangs
  FROM w LEFT JOIN covered USING (r)),
b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {rules} AS kept FROM b"""
