"""Removal of repeated passages: recurring phrases, sharded automata, first occurrences.

A window is ``window`` consecutive words of one document.  Each word covered by
a window whose word sequence also starts earlier (smaller doc_id, or the same
document and an earlier start) is removed; windows are judged on the input.

1. Copies: of documents with the same word sequence (at least a window long;
   told by the SHA-256 of its words) only the smallest doc_id is looked at
   further; the others lose every word.
2. Recurring phrases: of the phrases in each window the one with the smallest
   hash stands for it (winnowing), the same one wherever the window occurs.
   Phrases are counted over all documents; a window that repeats has a phrase
   that recurs.
3. Documents are dealt into shards of about ``SHARD_BYTES`` of text.  Each shard
   compiles an Aho-Corasick automaton of the recurring phrases that occur in it
   and streams the documents that hold any through it; windows around the
   located phrases are the candidates.  An automaton is
   bounded by its shard's text, and a text meets one automaton, however many
   phrases the corpus has.
4. Candidates are grouped by two 64-bit keys of the window's words; all but the
   first occurrence mark their words, which the last pass removes.

Defined cases: a null text has no words.  Rows that share a doc_id are one
document (equal rows keep the same words).  A row without doc_id loses nothing
and makes no other row lose words.  Only doc_id and text are read.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackml.llm import text as T
from trackml.llm.scratch import Scratch

SHARD_BYTES = 4 << 20


class Scan:
    """Words, phrases and window representatives of a slice of texts."""

    def __init__(self, s: T.Slice, window: int, phrase: int):
        self.slice, self.window, self.phrase = s, window, phrase
        self.words = T.words(s)
        self.hashes = T.word_hashes(s, self.words)
        self.phrases, self.first = T.ngrams(self.hashes, self.words.first, phrase)

    def representatives(self) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``phrases`` of each window's representative; first window per document."""
        span = self.window - self.phrase + 1
        count = np.maximum(np.diff(self.first) - span + 1, 0)
        first = np.concatenate([[0], np.cumsum(count)])
        starts = T.ranges(self.first[:-1], count)
        if not len(starts):
            return starts, first
        least = np.lib.stride_tricks.sliding_window_view(self.phrases, span)[starts]
        return starts + least.argmin(axis=1), first

    def text_keys(self) -> np.ndarray:
        """Two 64-bit keys of each document's whole word sequence, from its SHA-256."""
        return T.content_digests(self.slice, self.words)[:, :2]

    def word_list(self, i: int) -> list[str]:
        s, w = self.slice, self.words
        a, b = w.first[i], w.first[i + 1]
        if a == b:
            return []
        low = int(s.offsets[i])
        raw = s.text(i)
        return [raw[x - low:y - low].decode() for x, y in zip(
            w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)]


_SCANNED = ("doc_id long, text_key long, text_key2 long, n_words long, n_bytes long, "
            "phrases array<bigint>")


def _scan(window: int, phrase: int):
    def run(batches):
        for batch in batches:
            ids = T.column(batch, "doc_id")
            for s in T.slices(T.column(batch, "text")):
                scan = Scan(s, window, phrase)
                chosen, first = scan.representatives()
                # neighbouring windows share a representative; it counts once
                new = np.ones(len(chosen), bool)
                new[1:] = chosen[1:] != chosen[:-1]
                ends = np.concatenate([[0], np.cumsum(new)])[first].astype(np.int32)
                values = scan.phrases[chosen[new]].view(np.int64)
                keys = scan.text_keys()
                yield pa.record_batch([
                    ids.slice(s.lo, s.hi - s.lo), pa.array(keys[:, 0]),
                    pa.array(keys[:, 1]), pa.array(scan.words.count()),
                    pa.array(np.diff(s.offsets)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
                    names=["doc_id", "text_key", "text_key2", "n_words", "n_bytes", "phrases"])
    return run


_WINDOW = "key1 long, key2 long, doc_id long, text_key long, start int"


_WINDOW_TYPES = pa.schema([(f.split()[0], pa.int32() if f.endswith("int") else pa.int64())
                           for f in _WINDOW.split(", ")])


class Automaton:
    """Aho-Corasick automaton of a shard's recurring phrases."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = np.unique(wanted)
        self.found = np.zeros(len(self.wanted), bool)
        self.machine = ahocorasick.Automaton()

    def learn(self, scan: Scan) -> None:
        """Add the text of wanted phrases that this slice is the first to hold."""
        at = np.searchsorted(self.wanted, scan.phrases)
        at[at == len(self.wanted)] = 0
        hit = np.flatnonzero((self.wanted[at] == scan.phrases) & ~self.found[at])
        _, once = np.unique(scan.phrases[hit], return_index=True)
        hit = hit[once]
        self.found[at[hit]] = True
        docs = np.searchsorted(scan.first, hit, "right") - 1
        for i in np.unique(docs).tolist():
            words = scan.word_list(i)
            for p in (hit[docs == i] - scan.first[i]).tolist():
                self.machine.add_word(f" {' '.join(words[p:p + scan.phrase])} ", scan.phrase)

    def compile(self) -> None:
        self.machine.make_automaton()

    def located(self, words: list[str], count: int) -> np.ndarray:
        """For each of the document's ``count`` phrase places whether a phrase was found there."""
        found = np.zeros(count, bool)
        if self.machine.kind != ahocorasick.AHOCORASICK or not count:
            return found
        # the blank behind word i has the place ends[i]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        hits = [(last, n) for last, n in self.machine.iter(f" {' '.join(words)} ")]
        if hits:
            last, n = np.array(hits).T
            found[np.searchsorted(ends, last) - n + 1] = True
        return found


def _locate(window: int, phrase: int):
    def run(key, texts: pa.Table, phrases: pa.Table) -> pa.Table:
        texts = texts.filter(pc.is_in(texts["doc_id"], pc.unique(phrases["doc_id"])))
        if not len(texts):
            return pa.table({n: [] for n in _WINDOW_TYPES.names}, schema=_WINDOW_TYPES)
        ids = T.column(texts, "doc_id").to_numpy(zero_copy_only=False)
        machine = Automaton(T.column(phrases, "phrase").to_numpy().view(np.uint64))
        column = T.column(texts, "text")
        for s in T.slices(column):
            machine.learn(Scan(s, window, phrase))
        machine.compile()
        out = []
        for s in T.slices(column):
            scan = Scan(s, window, phrase)
            chosen, first = scan.representatives()
            found = np.concatenate([np.zeros(0, bool)] + [
                machine.located(scan.word_list(i), int(scan.first[i + 1] - scan.first[i]))
                for i in range(s.hi - s.lo)])
            hit = np.flatnonzero(found[chosen])
            doc = np.searchsorted(first, hit, "right") - 1
            start = hit - first[doc]
            begin = scan.words.first[doc] + start
            out.append(pa.table({
                "key1": T.run_hashes(scan.hashes, begin, begin + window).view(np.int64),
                "key2": T.run_hashes(scan.hashes, begin, begin + window, 1).view(np.int64),
                "doc_id": ids[s.lo:s.hi][doc], "text_key": scan.text_keys()[doc, 0],
                "start": start.astype(np.int32)}))
        return pa.concat_tables(out)
    return run


_KEPT = "doc_id long, n_words long, n_removed long, text string"


def _cut(window: int, phrase: int):
    def run(batches):
        for batch in batches:
            ids, marks = T.column(batch, "doc_id"), T.column(batch, "marks")
            for s in T.slices(T.column(batch, "text")):
                scan = Scan(s, window, phrase)
                count, keys = scan.words.count(), scan.text_keys()[:, 0]
                removed, kept = np.zeros(len(count), np.int64), []
                for i in range(len(count)):
                    words = scan.word_list(i)
                    own = [m for m in marks[s.lo + i].as_py() or []
                           if m["text_key"] == keys[i]]
                    if any(m["starts"] is None for m in own):
                        removed[i], words = count[i], []
                    elif own:
                        edge = np.zeros(len(words) + 1, np.int64)
                        starts = np.array(sorted({x for m in own for x in m["starts"]}))
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + window, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        removed[i] = gone.sum()
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    kept.append(" ".join(words))
                yield pa.record_batch([
                    ids.slice(s.lo, s.hi - s.lo), pa.array(count), pa.array(removed),
                    pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "text"])
    return run


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` per row; kept words are joined by one blank."""
    phrase = max(1, 2 * window // 5)
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = scratch.put("scanned", source.mapInArrow(_scan(window, phrase), _SCANNED))
    scanned = scanned.where("doc_id is not null and n_words >= {}".format(window))

    again = scratch.put("again", scanned.groupBy("text_key", "text_key2").agg(
        F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"))
        .where("lowest < highest").select("text_key", "text_key2", "lowest"))
    known = scanned.join(again, ["text_key", "text_key2"], "left").withColumn(
        "copy", F.coalesce(F.col("doc_id") != F.col("lowest"), F.lit(False)))
    copies = known.where("copy").select(
        "doc_id", "text_key", F.lit(None).cast("array<int>").alias("starts"))

    copies = scratch.put("copies", copies.distinct())
    places = known.where("not copy").select("doc_id", F.explode("phrases").alias("phrase"))
    recurring = scratch.put("recurring", places.groupBy("phrase").agg(
        F.count("*").alias("n")).where("n > 1").select("phrase"))
    hits = scratch.put("hits", places.join(recurring, "phrase", "left_semi")
                       .select("doc_id", "phrase"))
    size = scanned.agg(F.sum("n_bytes")).first()[0] or 0
    scratch.drop("scanned", "again", "recurring")
    shard = F.expr(f"pmod(xxhash64(doc_id), {size // SHARD_BYTES + 1})")
    texts = source.where("doc_id is not null").withColumn("shard", shard)
    windows = scratch.put("windows", texts.groupBy("shard").cogroup(
        hits.withColumn("shard", shard).groupBy("shard")).applyInArrow(
        _locate(window, phrase), _WINDOW))
    scratch.drop("hits")

    firsts = scratch.put("firsts", windows.groupBy("key1", "key2").agg(
        F.min(F.struct("doc_id", "start")).alias("first"),
        F.max(F.struct("doc_id", "start")).alias("last"))
        .where("first <> last").select("key1", "key2", F.col("first.doc_id").alias("first_doc"),
                                       F.col("first.start").alias("first_start")))
    later = windows.join(firsts, ["key1", "key2"]).where(
        "doc_id <> first_doc or start <> first_start").groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set("start")).alias("starts"))
    marks = scratch.put("marks", later.union(copies).groupBy("doc_id").agg(
        F.collect_list(F.struct("text_key", "starts")).alias("marks")))
    scratch.drop("copies", "windows", "firsts")
    return source.join(marks.hint("merge"), "doc_id", "left").select(
        "doc_id", "text", "marks").mapInArrow(_cut(window, phrase), _KEPT)
