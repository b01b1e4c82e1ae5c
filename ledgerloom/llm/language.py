"""Language identification in two steps: the family first, then the language within it.

Texts become square roots of hashed byte-trigram counts of unit length. Linear
support vector machines, one per family against the rest, choose the family;
inside it one machine per pair of languages votes, ties going to the larger sum
of margins. A text without a letter, or null, is ``und`` with score 0; so is
every text when nothing could be learnt. Only ``text`` is looked at when
predicting; texts are read whole and other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import common as C

SIZE = 2048
#: The machines are fitted on at most this many rows, dealt evenly over the languages.
TRAIN_ROWS = 4000
UNDETERMINED = "und"

# Language families; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_LETTER = np.full(256, 32, np.uint8)
for _a, _b in ((65, 91), (97, 123), (128, 256)):
    _LETTER[_a:_b] = np.arange(_a, _b)
_LETTER[65:91] += 32


def features(texts: C.Texts) -> np.ndarray:
    n = len(texts)
    c = _LETTER[texts.data].astype(np.uint32)
    if len(c) < 3:
        return np.zeros((n, SIZE), np.float32)
    code = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    doc = np.repeat(np.arange(n), np.diff(texts.starts))
    inside = (doc[2:] == doc[:-2]) & ((c[:-2] != 32) | (c[1:-1] != 32))
    at = doc[2:][inside] * SIZE + (code >> np.uint32(21)).astype(np.int64)[inside]
    x = np.sqrt(np.bincount(at, minlength=n * SIZE)).reshape(n, SIZE).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def machine(x: np.ndarray, positive: np.ndarray, rounds: int = 300, c: float = 20.0) -> np.ndarray:
    """Weights and intercept of a squared-hinge machine by accelerated gradient steps.

    Both classes weigh the same, and margins are scaled so that a logistic curve
    over them fits the training rows.
    """
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros(x1.shape[1], np.float32)
    v, rate = w.copy(), 1.0 / (4 * c + 1)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        grad = v - 2 * c * ((share * slack * y) @ x1)
        new = v - rate * grad
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return w


def _sample(documents: DataFrame, train_rows: int) -> DataFrame:
    """(text, lang) of at most ``train_rows`` ids, least hashes first, languages in turn; of rows of one id and language the least text.

    A language's ids above four times the sample's share of the hashes are left
    out before they are ordered, so no task orders a whole language.
    """
    labelled = documents.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    ids = labelled.select("doc_id", "lang").distinct()
    place = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5
    few = ids.join(ids.groupBy("lang").agg(F.count("*").alias("n")), "lang").where(place * F.col("n") <= 4 * train_rows)
    turn = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (few.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= train_rows)
              .orderBy("turn", "lang").limit(train_rows).select("doc_id", "lang"))
    return labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(
        F.min("text").alias("text"))


def fit(documents: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """Learn from rows with text and lang; the sample takes languages in turn until it is full, and repeated ids once."""
    rows = _sample(documents, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in C.text_chunks(batch.column("text")):
                x = features(texts).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(texts.rows[0], len(texts)), pa.array([r.tobytes() for r in x], pa.binary())],
                    ["lang", "x"])

    got = rows.select("text", "lang").mapInArrow(run, "lang string, x binary").toArrow()
    cases = sorted(zip(got["lang"].to_pylist(), got["x"].to_pylist()))
    langs = sorted({lang for lang, _ in cases})
    if not langs:
        return {"langs": []}
    x = np.frombuffer(b"".join(v for _, v in cases), np.float16).reshape(len(cases), SIZE).astype(np.float32)
    y = np.array([lang for lang, _ in cases])
    family = np.array([FAMILY_OF.get(lang, lang) for lang in y])
    families = sorted(set(family.tolist()))
    first = np.stack([machine(x, family == f) for f in families]) if len(families) > 1 else np.zeros((1, SIZE + 1), np.float32)
    pairs = {}
    for a, b in combinations(langs, 2):
        if FAMILY_OF.get(a, a) == FAMILY_OF.get(b, b):
            both = (y == a) | (y == b)
            pairs[a, b] = machine(x[both], y[both] == a)
    return {"langs": langs, "families": families, "first": first, "pairs": pairs,
            "members": {f: [lang for lang in langs if FAMILY_OF.get(lang, lang) == f] for f in families}}


def decide(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language of each row and the product of the logistic margins that led to it."""
    def logistic(m):
        return 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))

    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    margins = x1 @ model["first"].T
    best = margins.argmax(1)
    sure = logistic(margins[np.arange(len(x)), best]) if len(model["families"]) > 1 else np.ones(len(x))
    out = np.empty(len(x), object)
    for f, name in enumerate(model["families"]):
        here = np.flatnonzero(best == f)
        members = model["members"][name]
        votes, sums = np.zeros((2, len(here), len(members)))
        low = np.ones((len(here), len(members)))
        for i, j in combinations(range(len(members)), 2):
            m = x1[here] @ model["pairs"][members[i], members[j]]
            for k, s in ((i, m), (j, -m)):
                votes[:, k] += s > 0
                sums[:, k] += s
                low[:, k] = np.minimum(low[:, k], logistic(s))
        pick = (votes + 1e-3 * np.tanh(sums)).argmax(1)
        out[here] = np.array(members, object)[pick]
        sure[here] *= low[np.arange(len(here)), pick]
    return out, sure


def predict(documents: DataFrame, model: dict) -> DataFrame:
    """``documents`` with lang_pred and score (0 to 1); columns of these names are replaced."""
    documents = documents.drop("lang_pred", "score")
    names = documents.columns
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            text = batch.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            lang, sure = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows)
            if model["langs"]:
                for texts in C.text_chunks(text):
                    part = slice(texts.rows.start, texts.rows.stop)
                    lang[part], sure[part] = decide(model, features(texts))
            lang[~lettered], sure[~lettered] = UNDETERMINED, 0.0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(sure)], [*names, "lang_pred", "score"])

    return documents.mapInArrow(run, C.extended(documents, lang_pred="string", score="double"))
