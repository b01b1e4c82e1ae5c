"""Quality scores: hashed word n-grams and logistic regression trained by follow-the-regularised-leader.

A text is cut into runs of word bytes and runs of ASCII punctuation. Three kinds
of n-grams of these runs are hashed into one weight vector: single runs, pairs,
and triples of run shapes (case, length, punctuation itself, "same as the run
before"). Each kind's counts are scaled to unit length; a score is the sparse dot
product of the scaled counts with the weights.

Defined cases: a null or empty text has no n-grams and gets the intercept's
score; without any label the score is 0.5 everywhere. Repeated rows get equal
scores, texts are read whole, other columns pass through untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common as C

BITS = 18
#: The classifier is fitted on at most this many labelled rows, those with the smallest hash of the id.
TRAIN_ROWS = 3000
EPOCHS = 6
THRESHOLD = 0.7
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 1.0

_WORD, _PUNCT = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[33:128] = _PUNCT
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_a:_b] = _WORD
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def ngrams(texts: C.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of the hashed n-grams, values of one text and kind scaled to unit length."""
    data, n = texts.data, len(texts)
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[texts.starts[:-1][texts.starts[:-1] < len(data)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    solid = kind[starts] != 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[solid], ends[solid]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    lower = C.run_hashes(C.lower_ascii(data), starts, ends)
    doc = np.searchsorted(texts.starts, starts, "right") - 1
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    caps, size = upper[ends] - upper[starts], ends - starts
    punct = kind[starts] == _PUNCT
    same = np.zeros(len(starts), bool)
    same[1:] = (lower[1:] == lower[:-1]) & (doc[1:] == doc[:-1])
    case = np.where(caps == 0, 0, np.where(caps == 1, 1, 2)) + 3 * (size > 12)
    shape = np.where(punct, lower, C.mix((case + 7).astype(np.uint64)))
    shape = np.where(same, C.mix(shape + np.uint64(1)), shape)
    mask = np.uint64(2**BITS - 1)
    parts = [(doc, C.mix(lower + np.uint64(11)))]
    one = doc[1:] == doc[:-1]
    parts.append((doc[1:][one], C.mix(lower[:-1] * C.PLACE[0] + lower[1:] * C.PLACE[1])[one]))
    two = doc[2:] == doc[:-2]
    triple = C.mix(shape[:-2] * C.PLACE[2] + shape[1:-1] * C.PLACE[3] + shape[2:] * C.PLACE[4])[two]
    parts.append((doc[2:][two], triple))
    out = []
    for d, h in parts:
        keys, counts = np.unique(d * 2**BITS + (h & mask).astype(np.int64), return_counts=True)
        row = keys >> BITS
        value = np.log1p(counts)
        norm = np.sqrt(np.bincount(row, value * value, minlength=n))
        out.append((row, keys & (2**BITS - 1), value / norm[row]))
    return tuple(np.concatenate([p[i] for p in out]) for i in range(3))


class Ftrl:
    """FTRL-proximal with per-coordinate rates; weights of rare or uninformative n-grams stay zero."""

    def __init__(self, size: int = 2**BITS + 1):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2 * 0.01))

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (sigmoid(float(value @ w)) - label) * value
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - s * w
        self.n[at] += g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _sparse(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label, places and values of each text's n-grams, both compressed."""
    for batch in rows:
        labels = batch.column("label")
        for texts in C.text_chunks(batch.column("text")):
            doc, at, value = ngrams(texts)
            order = np.argsort(doc, kind="stable")
            doc, at, value = doc[order], at[order].astype(np.int32), value[order].astype(np.float32)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays(
                [labels.slice(texts.rows[0], len(texts)),
                 pa.array([zlib.compress(at[a:b].tobytes(), 1) for a, b in zip(cut, cut[1:])], pa.binary()),
                 pa.array([zlib.compress(value[a:b].tobytes(), 1) for a, b in zip(cut, cut[1:])], pa.binary())],
                ["label", "at", "value"])


def train(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learnt from a bounded sample of labelled documents.

    ``labels`` has doc_id and label; a document with several labels counts with
    the largest, and of rows of one id the least text counts. The sample is joined by
    a broadcast of at most ``train_rows`` ids.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("label").cast("int").alias("label"))
    features = rows.select("text", "label").mapInArrow(_sparse, "label int, at binary, value binary").toArrow()
    at, value = ([zlib.decompress(x) for x in features[name].to_pylist()] for name in ("at", "value"))
    cases = sorted(zip(features["label"].to_pylist(), at, value))
    model = Ftrl()
    if not cases:
        return model.weights()
    del features, at, value
    cases = [(float(y), np.append(np.frombuffer(a, np.int32), np.int32(2**BITS)),
              np.append(np.frombuffer(v, np.float32), np.float32(1))) for y, a, v in cases]
    random = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in random.permutation(len(cases)):
            y, at, value = cases[i]
            model.learn(at, value, y)
    return model.weights()


def score(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """``documents`` with a score of its whole text in [0, 1]; only ``text`` is looked at.

    A column named score is replaced.
    """
    documents = documents.drop("score")
    names = documents.columns
    small = np.flatnonzero(weights)
    shared = documents.sparkSession.sparkContext.broadcast((small.astype(np.int32), weights[small].astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(2**BITS + 1)
        w[shared.value[0]] = shared.value[1]
        for batch in batches:
            got = np.zeros(batch.num_rows)
            for texts in C.text_chunks(batch.column("text")):
                doc, at, value = ngrams(texts)
                got[texts.rows.start: texts.rows.stop] = np.bincount(doc, value * w[at], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(got + w[-1]))], [*names, "score"])

    return documents.mapInArrow(run, C.extended(documents, score="double"))
