"""Quality classifier: random-indexing word vectors, a two-layer network, temperature.

Items.  Each word of a text gives two items: its hashed spelling and its shape
(letter case, closing signs, digits, same as the word before, in a line seen
before).  Every item has a sparse random index vector (+1 and -1 at two hashed
places).

Word vectors.  Over *all* documents each item gathers the index vectors of the
items up to two words away (random indexing).  A task adds up one matrix of
fixed size; Spark sums the tasks' rows, and the unit-length result, a bounded
table of ``ITEMS`` rows, goes to the driver and back to the tasks.

Classifier.  A document is the mean of its word vectors, spellings and shapes
apart.  A two-layer numpy network learns from at most ``rows`` labelled
documents of each class (hash-ordered, never held out), of which one part is
kept back to fit a temperature, so that scores are probabilities.

Defined cases: a null or empty text has the zero vector and is scored like any
other.  Without usable labels of both classes every score is the share of
label 1 (0.5 without labels).  Rows that repeat are scored each; a row without
doc_id is not held out.  Only doc_id, text and the label are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackml.llm import labelled
from trackml.llm import text as T
from trackml.llm.scratch import bound_batches

SPELLINGS = 1 << 13
_CASES, _SIGNS = 5, 11
SHAPES = _CASES * _SIGNS * 8
ITEMS = SPELLINGS + SHAPES
DIMS = 32
TRAIN_ROWS = 6000
HIDDEN = 32

_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[0x61:0x7B] = _LOWER[0x80:] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[0x30:0x3A] = 1
_SIGN = np.zeros(256, np.int64)
_SIGN[0x21:0x7F] = 1
_SIGN[_UPPER + _LOWER + _DIGIT > 0] = 0
# kind of a closing sign: sentence marks, exclamation, bar, symbols, others
_KIND = np.where(_SIGN, 5, 0)
for _k, _chars in ((1, b".,;:"), (2, b"!"), (3, b"|"), (4, b"#$%&*<>")):
    _KIND[list(_chars)] = _k


def items(s: T.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spelling and shape item of each word, and the first word of each document."""
    w = T.words(s)
    hashes = T.word_hashes(s, w)
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64), w.first

    def count(table):
        return np.add.reduceat(table[s.data], w.starts)

    upper, lower, digit, sign = (count(t) for t in (_UPPER, _LOWER, _DIGIT, _SIGN))
    begins = _UPPER[s.data[w.starts]] > 0
    case = np.select([upper + lower == 0, upper == 0, (lower == 0) & (upper > 1),
                      begins & (upper == 1)], [0, 1, 2, 3], 4)
    kind = _KIND[s.data[w.ends - 1]]
    closing = np.where(kind == 0, np.where(sign > 0, 10, 0),
                       np.minimum(kind + 4 * (sign > 1), 9))
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    firsts = w.first[:-1]
    same[firsts[firsts < len(same)]] = False
    shape = (case * _SIGNS + closing) * 8 + (digit > 0) * 4 + same * 2 + _in_seen_line(s, w, hashes)
    return (hashes & np.uint64(SPELLINGS - 1)).astype(np.int64), SPELLINGS + shape, w.first


def _in_seen_line(s: T.Slice, w: T.Words, hashes: np.ndarray) -> np.ndarray:
    """Whether the word's line equals an earlier line of its document."""
    breaks = np.searchsorted(w.starts, np.flatnonzero(s.data == 0x0A))
    cuts = np.unique(np.concatenate([breaks, w.first]))
    begin, end = cuts[:-1], cuts[1:]
    doc = np.searchsorted(w.first, begin, "right") - 1
    key = T.mix(T.run_hashes(hashes, begin, end) + T.mix(doc.astype(np.uint64)))
    seen = np.ones(len(begin), bool)
    seen[np.unique(key, return_index=True)[1]] = False
    return np.repeat(seen, end - begin)


_PLACES = (T.seeds(41, ITEMS) % np.uint64(DIMS)).astype(np.int64)
_OTHERS = (_PLACES + 1 + (T.seeds(43, ITEMS) % np.uint64(DIMS - 1)).astype(np.int64)) % DIMS


def gather(s: T.Slice, total: np.ndarray) -> None:
    """Add the index vectors of neighbouring items to ``total`` (flat ITEMS x DIMS)."""
    spelling, shape, first = items(s)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for far in (1, 2):
        if len(doc) <= far:
            continue
        near = doc[far:] == doc[:-far]
        for one in (spelling, shape):
            for other in (spelling, shape):
                for centre, context in ((one[:-far][near], other[far:][near]),
                                        (one[far:][near], other[:-far][near])):
                    row = centre * DIMS
                    total += np.bincount(row + _PLACES[context], minlength=len(total))
                    total -= np.bincount(row + _OTHERS[context], minlength=len(total))


_COLUMNS = [f"d{k}" for k in range(DIMS)]


def _gather(batches):
    total = np.zeros(ITEMS * DIMS, np.int64)
    for batch in batches:
        for s in T.slices(T.column(batch, "text")):
            gather(s, total)
    rows = total.reshape(ITEMS, DIMS)
    used = np.flatnonzero(rows.any(axis=1))
    yield pa.record_batch([pa.array(used), *(pa.array(rows[used, k]) for k in range(DIMS))],
                          names=["item", *_COLUMNS])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all items over all documents, zero where an item never occurs."""
    bound_batches(docs.sparkSession)
    schema = ", ".join(f"{c} long" for c in ["item", *_COLUMNS])
    rows = docs.select("text").mapInArrow(_gather, schema).groupBy("item").agg(
        *(F.sum(c).alias(c) for c in _COLUMNS)).toArrow()
    out = np.zeros((ITEMS, DIMS), np.float32)
    own = np.stack([rows.column(c).to_numpy() for c in _COLUMNS], axis=1).astype(float)
    norm = np.linalg.norm(own, axis=1, keepdims=True)
    out[rows.column("item").to_numpy()] = own / np.maximum(norm, 1e-9)
    return out


def pooled(s: T.Slice, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each document, spellings and shapes apart."""
    spelling, shape, first = items(s)
    count = np.diff(first)
    out = np.zeros((len(count), 2 * DIMS), np.float32)
    full = count > 0
    if full.any():
        starts = first[:-1][full]
        for k, item in enumerate((spelling, shape)):
            out[full, k * DIMS:(k + 1) * DIMS] = np.add.reduceat(
                vectors[item], starts, axis=0) / count[full, None]
    return out


class Network:
    """Two layers and a temperature."""

    def __init__(self, prior: float = 0.5):
        self.mean = self.scale = self.w1 = self.b1 = self.w2 = None
        self.bias, self.temperature = float(np.log(prior / (1 - prior))), 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.01,
            decay: float = 1e-3) -> Network:
        """Full-batch Adam on the logistic loss."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        rng = np.random.default_rng(7)
        p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
             rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for t in range(1, steps + 1):
            h = np.maximum(x @ p[0] + p[1], 0)
            d = (sigmoid(h @ p[2] + p[3]) - y) / len(y)
            back = np.outer(d, p[2]) * (h > 0)
            grads = [x.T @ back + decay * p[0], back.sum(axis=0), h.T @ d + decay * p[2],
                     d.sum(keepdims=True)]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (
                    np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
        self.w1, self.b1, self.w2, self.bias = p[0], p[1], p[2], float(p[3][0])
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.bias)
        h = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.bias

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least logistic loss on rows not trained on."""
        z = self.logits(x)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        self.temperature = float(min(grid, key=lambda t: log_loss(z / t, y)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def _features(shared):
    def run(batches):
        for batch in batches:
            for s in T.slices(T.column(batch, "text")):
                rows = batch.slice(s.lo, s.hi - s.lo)
                x = pooled(s, shared.value)
                yield pa.record_batch(
                    [T.column(rows, "label"), T.column(rows, "fold"),
                     pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["label", "fold", "x"])
    return run


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label: str = "quality",
          rows: int = TRAIN_ROWS) -> Network:
    """Network from at most ``rows`` labelled documents of each class."""
    spark = docs.sparkSession
    chosen = labelled.sample(labels, label, rows).withColumnRenamed("doc_id", "labelled_id")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the sample is bounded by twice ``rows``
    picked = source.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select(
        "label", F.col("fold").cast("int").alias("fold"), "text")
    shared = spark.sparkContext.broadcast(vectors)
    found = picked.withColumn("label", F.col("label").cast("int")).mapInArrow(
        _features(shared), "label int, fold int, x binary").toArrow()
    y = found.column("label").to_numpy().astype(float)
    kept_back = found.column("fold").to_numpy() == labelled.CALIBRATION
    if not len(y) or y.min() == y.max():
        return Network(float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5)
    x = np.stack([np.frombuffer(b, np.float32) for b in found.column("x").to_pylist()])
    # the order of rows depends on tasks; sums shall not
    order = np.lexsort(np.c_[x, y].T)
    x, y, kept_back = x[order].astype(float), y[order], kept_back[order]
    learn = ~kept_back if len(set(y[~kept_back])) == 2 else np.ones(len(y), bool)
    network = Network().fit(x[learn], y[learn])
    if len(set(y[kept_back])) == 2:
        network.calibrate(x[kept_back], y[kept_back])
    return network


def _score(shared):
    def run(batches):
        vectors, network = shared.value
        for batch in batches:
            ids = T.column(batch, "doc_id")
            for s in T.slices(T.column(batch, "text")):
                yield pa.record_batch([ids.slice(s.lo, s.hi - s.lo),
                                       pa.array(network.scores(pooled(s, vectors)))],
                                      names=["doc_id", "score"])
    return run


def _keep(shared, threshold: float):
    def run(batches):
        vectors, network = shared.value
        for batch in batches:
            for s in T.slices(T.column(batch, "text")):
                good = network.scores(pooled(s, vectors)) >= threshold
                yield batch.slice(s.lo, s.hi - s.lo).filter(pa.array(good))
    return run


def good_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.7,
              rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(
        (vectors, train(docs, labels, vectors, rows=rows)))
    return docs.mapInArrow(_keep(shared, threshold), docs.schema)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = TRAIN_ROWS) \
        -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    vectors = word_vectors(docs)
    network = train(docs, labels, vectors, rows=rows)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _score(shared), "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(labelled.fold() == labelled.HELD_OUT, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
