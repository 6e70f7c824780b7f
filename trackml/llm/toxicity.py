"""Toxicity: a convolutional text classifier with thresholds by language.

A word's embedding is the sum of three hashed tables (two independent hashes of
the word, so that one collision is not enough to look like another word, and
one of its first bytes).  Filters of widths 1 to 3 slide over the whole text,
and the largest response of each filter feeds a logistic output.

Training takes every labelled document that is not held out.  The embedding
tables start from the words' class odds, counted by Spark over all of them.
Embeddings, filters and output are then trained together (sparse Adagrad: max
pooling touches few words): documents are dealt by a hash of their id to shards
of about ``SHARD_ROWS``, in each of ``ROUNDS`` rounds every shard's rows are
learned from in a fixed order, and Spark averages what the shards changed.
Changes are added up as fixed-point integers, so that the order of tasks does
not matter.  The driver holds one model, whatever the number of documents.

A quarter of the labelled documents is kept back from this.  Spark counts all
of them by language, as the text's own function words tell it, and by logit in
steps of ``1 / STEPS``.  On the counts a temperature is fitted, and for each
language the probability threshold with the best F1.  Scores are shifted so
that a language's threshold becomes ``threshold``.

Scoring never looks at labels, lang, source or doc_id.  The filters applied to
the tables are computed once, so that a text costs table look-ups, sums and a
maximum.

Defined cases: a text without words has no response and is scored like any
other.  Without labels of both classes every score is the share of label 1
(0.5 without labels).  Rows that repeat are scored each; a row without doc_id
is not held out.  Only doc_id, text and the label are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackml.llm import labelled
from trackml.llm import text as T
from trackml.llm.quality_model import sigmoid
from trackml.llm.scratch import Scratch

BUCKETS = 1 << 16
TABLES = 3
DIMS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
TAPS = sum(WIDTHS) * FILTERS
HEAD_BYTES = 5
MAPS = len(WIDTHS) * FILTERS
# learning: labelled documents of a shard, passes over all of them, documents of a step
SHARD_ROWS = 8192
ROUNDS = 6
STEP_ROWS = 32
# words whose responses are held at once
PIECE_WORDS = 1 << 16
# labels that are broadcast to the documents; more are joined by a shuffle
BROADCAST_LABELS = 500_000
# logits are counted in steps of 1 / STEPS between -LIMIT and LIMIT
STEPS, LIMIT = 512, 32
# changes are added up as multiples of 1 / UNIT
UNIT = float(1 << 32)

# Function words that tell a language: fixed values
LANGUAGES = {
    "en": "the of and to in is that it for was on are as with be by at this from or",
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine",
    "fr": "le les et des du une est pour qui dans par plus pas au sur ne ce il",
    "es": "el los las del y por con no su para al lo como más pero sus o este",
}


def words(s: T.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of each word (words x TABLES), word hashes, first word per document."""
    w = T.words(s, T.ALNUM)
    whole = T.word_hashes(s, w, lower=True)
    head = T.range_hashes(T.LOWER[s.data], w.starts, np.minimum(w.ends, w.starts + HEAD_BYTES))
    mask = np.uint64(BUCKETS - 1)
    return np.stack([whole & mask, (whole >> np.uint64(32)) & mask, head & mask],
                    axis=1).astype(np.int32), whole, w.first


def _telling() -> list[np.ndarray]:
    """Hashes of each language's function words that no other language shares."""
    lists = [set(line.split()) for line in LANGUAGES.values()]
    out = []
    for k, own in enumerate(lists):
        only = sorted(own - set().union(*lists[:k], *lists[k + 1:]))
        [s] = T.slices(pa.array([" ".join(only)]))
        out.append(np.sort(T.word_hashes(s, T.words(s, T.ALNUM), lower=True)))
    return out


TELLING = _telling()


def language(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Place in ``LANGUAGES`` of each document, or one past the last if nothing tells."""
    hits = np.zeros((len(TELLING) + 1, len(first) - 1))
    hits[-1] = 0.5
    for k, own in enumerate(TELLING):
        total = np.concatenate([[0], np.cumsum(np.isin(hashes, own))])
        hits[k] = total[first[1:]] - total[first[:-1]]
    return hits.argmax(axis=0)


def responses(taps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Responses of all filters at every word; taps beyond a document's end add nothing."""
    end = np.repeat(first[1:], np.diff(first))
    place = np.arange(len(taps))
    parts, at = [], 0
    for width in WIDTHS:
        out = taps[:, at:at + FILTERS].copy()
        for j in range(1, width):
            own = taps[j:, at + j * FILTERS:at + (j + 1) * FILTERS]
            out[:len(own)] += own * (place[:len(own)] + j < end[:len(own)])[:, None]
        parts.append(out)
        at += width * FILTERS
    return np.concatenate(parts, axis=1)


def largest(y: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest response of each filter per document, zero for a document without words."""
    out = np.zeros((len(first) - 1, y.shape[1]), np.float32)
    full = np.diff(first) > 0
    if full.any():
        out[full] = np.maximum.reduceat(y, first[:-1][full], axis=0)
    return out


def peaks(taps, first: np.ndarray, piece: int = PIECE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter per document and the word where it begins.

    ``taps(lo, hi)`` gives the filter taps of words ``lo:hi``; they are asked for
    ``piece`` words at a time, so a long document is taken whole in bounded memory.
    """
    docs, words_ = len(first) - 1, int(first[-1])
    top = np.full((docs, MAPS), -np.inf, np.float32)
    where = np.zeros((docs, MAPS), np.int64)
    for lo in range(0, words_, piece):
        hi = min(lo + piece, words_)
        look = min(hi + max(WIDTHS) - 1, words_)
        r = responses(taps(lo, look), np.clip(first, lo, look) - lo)
        for d in range(np.searchsorted(first, lo, "right") - 1, docs):
            begin, end = max(first[d], lo) - lo, min(first[d + 1], hi) - lo
            if first[d] >= hi:
                break
            if begin >= end:
                continue
            at = begin + r[begin:end].argmax(axis=0)
            value = r[at, np.arange(MAPS)]
            better = value > top[d]
            top[d, better] = value[better]
            where[d, better] = at[better] + lo
    top[np.diff(first) == 0] = 0
    return top, where


class Weights:
    """All trained numbers as rows of ``DIMS``: embeddings, filter taps, then the output."""

    EMBEDDED = TABLES * BUCKETS
    ROWS = EMBEDDED + TAPS + 2 * MAPS // DIMS + 1

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        taps, part = self.EMBEDDED + TAPS, MAPS // DIMS
        self.e = rows[:self.EMBEDDED]
        self.k = rows[self.EMBEDDED:taps]
        self.b = rows[taps:taps + part].reshape(-1)
        self.w = rows[taps + part:taps + 2 * part].reshape(-1)
        self.c = rows[-1, :1]

    @classmethod
    def first(cls, odds: np.ndarray) -> Weights:
        rng = np.random.default_rng(11)
        out = cls(np.zeros((cls.ROWS, DIMS), np.float32))
        out.e[:] = rng.normal(0, 0.05, out.e.shape)
        out.e[:, 0] = odds
        out.k[:] = rng.normal(0, 0.1, (DIMS, TAPS)).T
        out.k[:FILTERS, 0] = 0.5
        out.w[:] = 0.3
        return out

    def embed(self, places: np.ndarray) -> np.ndarray:
        """Embeddings of words, given the rows of their table entries."""
        x = self.e[places[:, 0]]
        for t in range(1, TABLES):
            x += self.e[places[:, t]]
        return x


#: row of the first entry of each table
_TABLE_ROWS = np.arange(TABLES, dtype=np.int64) * BUCKETS


class Learner:
    """One shard's learning in one round, from the weights that all shards start with."""

    def __init__(self, rows: np.ndarray, sums: np.ndarray, class_weight: tuple[float, float],
                 rate: float = 0.1):
        self.start, self.start_sums = rows, sums
        self.p, self.s = Weights(rows.copy()), Weights(sums.copy())
        self.class_weight, self.rate = class_weight, rate
        self.touched = np.zeros(Weights.ROWS, bool)
        self.touched[Weights.EMBEDDED:] = True

    def _step(self, p, s, grad, where=...):
        s[where] += grad * grad
        p[where] -= self.rate * grad / np.sqrt(s[where])

    def step(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """One step of sparse Adagrad; documents without words teach nothing."""
        full = [i for i, t in enumerate(texts) if len(t)]
        if not full:
            return
        y, p, s = y[full], self.p, self.s
        first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in full])])
        places = np.concatenate([texts[i] for i in full]) + _TABLE_ROWS
        taps = np.ascontiguousarray(p.k.T)
        top, where = peaks(lambda lo, hi: p.embed(places[lo:hi]) @ taps, first)
        h = top + p.b
        z = np.maximum(h, 0)
        weight = np.where(y == 1, self.class_weight[1], self.class_weight[0])
        d = ((sigmoid(z @ p.w + p.c) - y) * weight / len(y)).astype(np.float32)
        back = np.outer(d, p.w) * (h > 0)
        grad_k, touched, grad_x, at = np.zeros_like(p.k), [], [], 0
        for g, width in enumerate(WIDTHS):
            cols = slice(g * FILTERS, (g + 1) * FILTERS)
            for j in range(width):
                place = where[:, cols] + j
                doc, f = np.nonzero((place < first[1:, None]) & (back[:, cols] != 0))
                col = at + j * FILTERS + f
                word, g_out = place[doc, f], back[doc, g * FILTERS + f]
                np.add.at(grad_k, col, p.embed(places[word]) * g_out[:, None])
                touched.append(word)
                grad_x.append(p.k[col] * g_out[:, None])
            at += width * FILTERS
        self._step(p.w, s.w, z.T @ d)
        self._step(p.c, s.c, d.sum(keepdims=True))
        self._step(p.b, s.b, back.sum(axis=0))
        touched, grad_x = np.concatenate(touched), np.concatenate(grad_x)
        for t in range(TABLES):
            rows, inverse = np.unique(places[touched, t], return_inverse=True)
            total = np.zeros((len(rows), DIMS), np.float32)
            np.add.at(total, inverse, grad_x)
            self._step(p.e, s.e, total, rows)
            self.touched[rows] = True
        self._step(p.k, s.k, grad_k)

    def changes(self) -> tuple[np.ndarray, np.ndarray]:
        """Touched rows, and the change of their weights and sums in ``UNIT``."""
        rows = np.flatnonzero(self.touched)
        both = np.concatenate([self.p.rows[rows].astype(float) - self.start[rows],
                               self.s.rows[rows].astype(float) - self.start_sums[rows]], axis=1)
        return rows, np.rint(both * UNIT).astype(np.int64)


class Model:
    """Scores from tables of filter taps."""

    def __init__(self, prior: float = 0.5):
        self.prior = float(np.log(prior / (1 - prior)))
        self.tables = None
        self.temperature = 1.0
        self.shift = np.zeros(len(TELLING) + 1)

    def close(self, p: Weights) -> Model:
        self.tables = (p.e @ p.k.T).reshape(TABLES, BUCKETS, TAPS)
        self.b, self.w, self.c = p.b, p.w, p.c
        return self

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.tables is None:
            return np.full(len(first) - 1, self.prior)
        taps = self.tables[0][ids[:, 0]]
        for t in range(1, TABLES):
            taps += self.tables[t][ids[:, t]]
        h = largest(responses(taps, first), first) + self.b
        return (np.maximum(h, 0) @ self.w + self.c).astype(float)

    def calibrate(self, z: np.ndarray, lang: np.ndarray, y: np.ndarray, n: np.ndarray,
                  threshold: float, least: int = 20) -> None:
        """Temperature, then each language's best threshold moved to ``threshold``.

        Of ``n`` documents with logit ``z`` and language ``lang``, ``y`` are of
        class 1.  A language with fewer than ``least`` documents of either class
        takes the threshold of all languages.
        """
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        self.temperature = float(min(
            grid, key=lambda t: np.sum(n * np.logaddexp(0, z / t) - y * z / t)))
        z, aim = z / self.temperature, np.log(threshold / (1 - threshold))
        common = best_cut(z, y, n)
        for k in range(len(self.shift)):
            own = lang == k
            enough = min(y[own].sum(), (n[own] - y[own]).sum()) >= least
            self.shift[k] = aim - (best_cut(z[own], y[own], n[own]) if enough else common)

    def scores(self, ids: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.tables is None:
            return sigmoid(np.full(len(first) - 1, self.prior))
        return sigmoid(self.logits(ids, first) / self.temperature
                       + self.shift[language(hashes, first)])


def best_cut(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The logit cut with the best F1, midway between the rows it parts.

    A row stands for ``n`` documents (1 each by default), ``y`` of them of class 1.
    """
    n = np.ones(len(z)) if n is None else n
    order = np.argsort(-z, kind="stable")
    z, y, n = z[order], y[order], n[order]
    f1 = 2 * np.cumsum(y) / (np.cumsum(n) + y.sum())
    last = np.append(z[1:] != z[:-1], True)
    i = int(np.where(last, f1, -1).argmax())
    return float((z[i] + z[i + 1]) / 2 if i + 1 < len(z) else z[i] - 1)


def _ids(batches):
    for batch in batches:
        for s in T.slices(T.column(batch, "text")):
            own = batch.slice(s.lo, s.hi - s.lo)
            ids, hashes, first = words(s)
            lang = language(hashes, first)
            ids = ids.astype("<u2")  # BUCKETS is 2^16
            yield pa.record_batch(
                [T.column(own, "doc_id"), T.column(own, "label"), T.column(own, "fold"),
                 pa.array(lang.astype(np.int32)),
                 pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)],
                          pa.binary())],
                names=["doc_id", "label", "fold", "language", "ids"])


_LABELLED = "doc_id long, label int, fold int, language int, ids binary"


def _unpacked(blob) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), "<u2").reshape(-1, TABLES).astype(np.int64)


def _hold(batches):
    """Documents of each class that hold a bucket, added up per task."""
    held = np.zeros((2, TABLES * BUCKETS), np.int64)
    for batch in batches:
        for label, blob in zip(T.column(batch, "label").to_pylist(), T.column(batch, "ids"),
                               strict=True):
            held[label, np.unique(_unpacked(blob) + _TABLE_ROWS)] += 1
    rows = np.flatnonzero(held.any(axis=0))
    yield pa.record_batch([pa.array(rows), pa.array(held[0, rows]), pa.array(held[1, rows])],
                          names=["place", "n0", "n1"])


def odds(learned: DataFrame, n: tuple[int, int]) -> np.ndarray:
    """Smoothed log odds of class 1 among the documents that hold a bucket."""
    found = learned.select("label", "ids").mapInArrow(
        _hold, "place long, n0 long, n1 long").groupBy("place").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    out = np.zeros(TABLES * BUCKETS, np.float32)
    share = [(found.column(f"n{c}").to_numpy() + 0.5) / (n[c] + 1) for c in (0, 1)]
    out[found.column("place").to_numpy()] = np.log(share[1] / share[0]) / TABLES
    return out


def _steps(batches):
    """``shard, texts, labels`` of ``STEP_ROWS`` documents, in the order of the rows."""
    shard, texts, y = None, [], []
    for batch in batches:
        for own, label, blob in zip(T.column(batch, "shard").to_pylist(),
                                    T.column(batch, "label").to_pylist(),
                                    T.column(batch, "ids"), strict=True):
            if texts and (own != shard or len(texts) == STEP_ROWS):
                yield shard, texts, np.array(y, float)
                texts, y = [], []
            shard = own
            texts.append(_unpacked(blob))
            y.append(label)
    if texts:
        yield shard, texts, np.array(y, float)


_VALUES = [f"v{i}" for i in range(2 * DIMS)]


def _learn(shared, class_weight):
    def run(batches):
        rows, sums = shared.value
        total = np.zeros((Weights.ROWS, 2 * DIMS), np.int64)
        shards = np.zeros(Weights.ROWS, np.int64)

        def add(learner):
            touched, values = learner.changes()
            total[touched] += values
            shards[touched] += 1

        shard, learner = None, None
        for own, texts, y in _steps(batches):
            if own != shard:
                if learner is not None:
                    add(learner)
                shard, learner = own, Learner(rows, sums, class_weight)
            learner.step(texts, y)
        if learner is not None:
            add(learner)
        touched = np.flatnonzero(shards)
        yield pa.record_batch(
            [pa.array(touched), pa.array(shards[touched]),
             *(pa.array(total[touched, i]) for i in range(2 * DIMS))],
            names=["place", "shards", *_VALUES])
    return run


def learn(learned: DataFrame, n: tuple[int, int], rounds: int = ROUNDS) -> Weights:
    """Weights after ``rounds`` passes over all rows of ``learned``, averaged over shards.

    A weight is averaged over the shards that touched it.
    """
    spark = learned.sparkSession
    share = n[1] / sum(n)
    class_weight = (0.5 / max(1 - share, 1e-3), 0.5 / max(share, 1e-3))
    p = Weights.first(odds(learned, n))
    sums = np.full_like(p.rows, 1e-3)
    schema = ", ".join(f"{c} long" for c in ["place", "shards", *_VALUES])
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((p.rows, sums))
        found = learned.select("shard", "label", "ids").mapInArrow(
            _learn(shared, class_weight), schema).groupBy("place").agg(
            *(F.sum(c).alias(c) for c in ["shards", *_VALUES])).toArrow()
        place, shards = found.column("place").to_numpy(), found.column("shards").to_numpy()
        change = np.stack([found.column(c).to_numpy() for c in _VALUES], axis=1) / (
            UNIT * shards[:, None])
        rows = p.rows.copy()
        rows[place] += change[:, :DIMS].astype(np.float32)
        sums = sums.copy()
        sums[place] += change[:, DIMS:].astype(np.float32)
        p = Weights(rows)
        shared.destroy()
    return p


def _logits(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            blobs = T.column(batch, "ids")
            z = np.array([model.logits(r, np.array([0, len(r)]))[0]
                          for r in map(_unpacked, blobs)])
            step = np.rint(np.clip(z, -LIMIT, LIMIT) * STEPS).astype(np.int32)
            yield pa.record_batch([T.column(batch, "language"), T.column(batch, "label"),
                                   pa.array(step, pa.int32())], names=["language", "label", "step"])
    return run


def calibrate(model: Model, checked: DataFrame, threshold: float) -> None:
    """Temperature and thresholds of ``model`` from all rows of ``checked``."""
    shared = checked.sparkSession.sparkContext.broadcast(model)
    counts = checked.select("language", "label", "ids").mapInArrow(
        _logits(shared), "language int, label int, step int").groupBy("language", "step").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).orderBy("language", "step").toArrow()
    lang, step, n, y = (counts.column(c).to_numpy() for c in ("language", "step", "n", "y"))
    model.calibrate(step / STEPS, lang, y.astype(float), n.astype(float), threshold)
    shared.destroy()


def staged(docs: DataFrame, labels: DataFrame, label: str, scratch: Scratch) -> DataFrame:
    """``shard, doc_id, label, fold, language, ids`` of every labelled document not held out.

    A shard's rows are neighbours in one file, in hash order.
    """
    chosen = labelled.usable(labels, label).withColumnRenamed("doc_id", "labelled_id")
    n = chosen.count()
    if n <= BROADCAST_LABELS:
        chosen = F.broadcast(chosen)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        labelled.fold() != labelled.HELD_OUT)
    shards = max(1, -(-n // SHARD_ROWS))
    rows = source.join(chosen, F.col("doc_id") == F.col("labelled_id")).select(
        "doc_id", F.col("label").cast("int").alias("label"),
        F.col("fold").cast("int").alias("fold"), "text").mapInArrow(_ids, _LABELLED)
    return scratch.put("labelled", rows.repartition(shards, "doc_id").select(
        F.pmod(F.hash("doc_id"), F.lit(shards)).alias("shard"), "*").sortWithinPartitions(
        "shard", F.xxhash64("doc_id"), "doc_id", "ids", "label"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3) \
        -> Model:
    """Model from every labelled document that is not held out."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = staged(docs, labels, label, scratch)
    kept_back = F.col("fold") == labelled.CALIBRATION
    counts = {True: [0, 0], False: [0, 0]}
    for r in rows.groupBy(kept_back.alias("kept_back"), "label").count().collect():
        counts[r["kept_back"]][r["label"]] = r["count"]
    both = [a + b for a, b in zip(counts[True], counts[False], strict=True)]
    if not all(both):
        scratch.drop("labelled")
        share = both[1] / sum(both) if any(both) else 0.5
        return Model(float(np.clip(share, 1e-3, 1 - 1e-3)))
    learned, n = (rows.where(~kept_back), counts[False]) if all(counts[False]) else (rows, both)
    model = Model().close(learn(learned, tuple(n)))
    calibrate(model, rows.where(kept_back) if all(counts[True]) else rows, threshold)
    scratch.drop("labelled")
    return model


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            own = T.column(batch, "doc_id")
            for s in T.slices(T.column(batch, "text"), T.SLICE_BYTES // 2):
                yield pa.record_batch([own.slice(s.lo, s.hi - s.lo),
                                       pa.array(model.scores(*words(s)))],
                                      names=["doc_id", "score"])
    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    model = train(docs, labels, threshold=threshold)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _score(shared), "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(labelled.fold() == labelled.HELD_OUT, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
