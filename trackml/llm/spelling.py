"""Spelling variants of the corpus' words, by PartEnum signatures over letter multisets.

Words.  Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased.  Where
97 divides the crc32 of ``<doc_id>:<run>`` the run loses its letter number
``crc % length``.  The distinct results with at least ``Params.letters`` code
points and ``Params.count`` occurrences in all documents are the words.  Each
task counts its documents before the shuffle.

Near words differ by one inserted, deleted or replaced letter.  A word's letter
multiset is a binary vector over (letter, which occurrence); near words' vectors
have a Hamming distance of at most two.  The places are dealt into
``Params.parts`` parts of about equal weight; two differing places spoil at
most two parts, so near words agree on some choice of all but two parts.  A
signature is such a choice with its parts' letters (PartEnum with one
first-level part), the shorter word's length, and the word's front or back
half of that length, one of which survives any single edit.  Signatures are
joined by equality, and each candidate is verified by its edit distance.

Forms.  A word's form is its near word of largest count n (ties: smallest in
code-point order) if that n is at least ``Params.lead`` times its own.  Counts
at least double along forms, so the forms make a forest; roots spread down it
level by level, and as a word has a bounded number of near words, so has each
join key.

Defined cases: a null text has no words; a row without doc_id counts under an
empty id; rows that repeat count each.  Only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackml.llm import text as T
from trackml.llm.scratch import Scratch

RUN = re.compile("[a-zÀ-ÿ]+")
SLIP = 97
#: Hamming distance of the vectors of near words
DISTANCE = 2
#: distinct words a task counts before it hands them on
TASK_WORDS = 1 << 18
#: occurrences of a letter in a word that are weighed one by one; later ones take turns
WEIGHED = 8


@dataclass(frozen=True)
class Params:
    letters: int = 5
    count: int = 3
    lead: int = 2
    parts: int = 4


def counted(doc_id: str, text: str) -> Counter[str]:
    """The document's words after slips, with their occurrences."""
    prefix = zlib.crc32(f"{doc_id}:".encode())
    out: Counter[str] = Counter()
    # lower() of bytes folds A-Z alone
    for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(word.encode(), prefix)
        if h % SLIP == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        out[word] += n
    return out


def _count(letters: int):
    def run(batches):
        seen: Counter[str] = Counter()

        def flush():
            rows = pa.record_batch([pa.array(list(seen), pa.string()),
                                    pa.array(list(seen.values()), pa.int64())],
                                   names=["word", "n"])
            seen.clear()
            return rows

        for batch in batches:
            for doc_id, text in zip(T.column(batch, "doc_id"), T.column(batch, "text"),
                                    strict=True):
                if not text.is_valid:
                    continue
                own = counted(str(doc_id.as_py()) if doc_id.is_valid else "", text.as_py())
                seen.update({w: n for w, n in own.items() if len(w) >= letters})
                if len(seen) > TASK_WORDS:
                    yield flush()
        yield flush()
    return run


def word_counts(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``word, n`` of all words."""
    partial = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(
        _count(params.letters), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= params.count)


def places(word: str) -> list[tuple[str, int]]:
    """The ones of the word's vector: each letter with the number of its occurrence."""
    seen: Counter[str] = Counter()
    out = []
    for letter in word:
        seen[letter] += 1
        out.append((letter, seen[letter]))
    return out


def _weigh(batches):
    seen: Counter[tuple[str, int]] = Counter()
    for batch in batches:
        for word in T.column(batch, "word").to_pylist():
            seen.update(p for p in places(word) if p[1] <= WEIGHED)
    yield pa.record_batch([pa.array([p[0] for p in seen], pa.string()),
                           pa.array([p[1] for p in seen], pa.int32()),
                           pa.array(list(seen.values()), pa.int64())],
                          names=["letter", "nth", "n"])


def deal(words: DataFrame, parts: int) -> dict[tuple[str, int], int]:
    """The part of each weighed place, at most ``WEIGHED`` for each letter of the alphabet.

    The heaviest place goes to the lightest part first.
    """
    rows = words.select("word").mapInArrow(_weigh, "letter string, nth int, n long").groupBy(
        "letter", "nth").agg(F.sum("n").alias("n")).collect()
    weight = [0] * parts
    part = {}
    for r in sorted(rows, key=lambda r: (-r.n, r.letter, r.nth)):
        part[r.letter, r.nth] = i = min(range(parts), key=lambda k: (weight[k], k))
        weight[i] += r.n
    return part


def split_parts(word: str, part: dict[tuple[str, int], int], parts: int) -> list[str]:
    """The word's letters by part, in order, so that equal multisets give equal strings."""
    out: list[list[str]] = [[] for _ in range(parts)]
    for place in sorted(places(word)):
        out[part.get(place, (ord(place[0]) + place[1]) % parts)].append(place[0])
    return ["".join(p) for p in out]


def _with_parts(part: dict[tuple[str, int], int], parts: int):
    def run(batches):
        for batch in batches:
            words = T.column(batch, "word")
            yield pa.record_batch([
                words, T.column(batch, "n"),
                pa.array([split_parts(w, part, parts) for w in words.to_pylist()],
                         pa.list_(pa.string()))], names=["word", "n", "parts"])
    return run


def _signatures(length: Column, parts: int) -> Column:
    """Hashes of all signatures for pairs whose shorter word has ``length`` letters."""
    half = (length / 2).cast("int")
    sides = (F.left("word", half), F.right("word", half))
    return F.array(*(
        F.xxhash64(length, F.lit(side), text, F.lit(k), *(F.get("parts", i) for i in chosen))
        for side, text in enumerate(sides)
        for k, chosen in enumerate(combinations(range(parts), parts - DISTANCE))))


def near_pairs(scratch: Scratch, words: DataFrame, params: Params = Params()) -> DataFrame:
    """``left, left_n, right, right_n``, each pair of near words once."""
    part = deal(words, params.parts)
    split = scratch.put("parts", words.mapInArrow(
        _with_parts(part, params.parts), "word string, n long, parts array<string>"))
    length = F.length("word")

    def signed(shorter: Column) -> DataFrame:
        return split.select("word", "n", F.explode(_signatures(shorter, params.parts)).alias("sig"))

    left = signed(length).toDF("left", "left_n", "sig")
    right = signed(length).union(signed(length - 1)).toDF("right", "right_n", "sig")
    ahead = (F.length("right") > F.length("left")) | (F.col("left") < F.col("right"))
    near = F.levenshtein("left", "right", 1) == 1
    # a pair may share several signatures; a hashed signature only proposes
    return left.join(right, "sig").where(ahead & near).select(
        "left", "left_n", "right", "right_n").distinct()


def variants(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``word, form, root, n, n_near, form_n``, one row per word."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.put("words", word_counts(docs, params))
    pairs = scratch.put("pairs", near_pairs(scratch, words, params))
    scratch.drop("parts")
    both = pairs.select(F.col("left").alias("word"), F.col("left_n").alias("n"),
                        F.col("right").alias("near"), F.col("right_n").alias("near_n")).union(
        pairs.select("right", "right_n", "left", "left_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    judged = scratch.put("near", both.groupBy("word").agg(
        F.max("n").alias("n"), F.count("*").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.when(-F.col("best.m") >= params.lead * F.col("n"),
                                 F.struct(F.col("best.near").alias("form"),
                                          (-F.col("best.m")).alias("form_n"))).alias("own"))
        .select("word", "n_near", "own.form", "own.form_n"))
    scratch.drop("pairs")

    forms = judged.where("form is not null").select("word", "form")
    # words that are forms and have none themselves, then level by level what hangs on them
    level = scratch.put("level0", forms.select(F.col("form").alias("word")).distinct().join(
        forms, "word", "left_anti").select("word", F.col("word").alias("root")))
    rooted = None
    depth = 0
    while not level.isEmpty():
        depth += 1
        level = scratch.put(f"level{depth}", forms.join(
            level.withColumnRenamed("word", "form"), "form").select("word", "root"))
        rooted = level if rooted is None else rooted.union(level)
    out = words.join(judged, "word", "left")
    out = out.withColumn("root", F.lit(None).cast("string")) if rooted is None \
        else out.join(rooted, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                      F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                      F.col("form_n").cast("long").alias("form_n"))
