"""Approximate nearest neighbours by learned partitions.

On a bounded sample a graph of nearest neighbours is cut into parts of equal size
with few edges between them; a softmax classifier learns, for a vector, how its
neighbours spread over the parts. Every row is indexed in its likeliest part. A
query looks at its likeliest parts - as many as gave the wanted recall on the
sample - and ranks what it finds by exact Euclidean distance.

Defined cases: vectors that are null, zero, of another length than most of the
sample, or hold null or non-finite parts take no part, nor do null ids; a row is
never its own neighbour (nor is a row of the same id); ties go to the smaller id;
with fewer candidates all are returned, and parts are added until there are k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Workspace

#: Vectors the graph and the classifier are fitted on, those with the smallest hash of the id.
SAMPLE = 6000
PART_ROWS = 2048
FEWEST_PARTS, MOST_PARTS = 8, 512
DEGREE = 10
RECALL = 0.97
#: Vectors and queries that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, v): ids and double vectors that can take part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(sound, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    norm = (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        d = norm - 2 * x[a: a + 512] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a: a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _halve(x: np.ndarray, rows: np.ndarray, parts: int, label: np.ndarray, first: int) -> None:
    """Start: cut along the widest direction, in proportion to the parts each side gets."""
    if parts == 1 or len(rows) == 0:
        label[rows] = first
        return
    y = x[rows] - x[rows].mean(0)
    axis = np.random.default_rng(first).normal(size=y.shape[1])
    for _ in range(12):
        axis = y.T @ (y @ axis)
        axis /= max(np.linalg.norm(axis), 1e-300)
    order = np.argsort(y @ axis, kind="stable")
    left = parts // 2
    cut = len(rows) * left // parts
    _halve(x, rows[order[:cut]], left, label, first)
    _halve(x, rows[order[cut:]], parts - left, label, first + left)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 8) -> np.ndarray:
    """Parts of nearly equal size with few graph edges between them: halving, then moves that save edges."""
    label = np.zeros(len(x), np.int64)
    _halve(x, np.arange(len(x)), parts, label, 0)
    back: list[list[int]] = [[] for _ in range(len(x))]
    for i, row in enumerate(near.tolist()):
        for j in row:
            back[j].append(i)
    links = [np.array(a + b) for a, b in zip(near.tolist(), back)]
    size = np.bincount(label, minlength=parts)
    top, low = slack * len(x) / parts, len(x) / parts / slack
    random = np.random.default_rng(5)
    for _ in range(rounds):
        moved = 0
        for i in random.permutation(len(x)):
            votes = np.bincount(label[links[i]], minlength=parts)
            to, own = int(votes.argmax()), label[i]
            if votes[to] > votes[own] and size[to] < top and size[own] > low:
                size[to] += 1
                size[own] -= 1
                label[i] = to
                moved += 1
        if not moved:
            break
    return label


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _inputs(x: np.ndarray, model: dict) -> np.ndarray:
    y = (x - model["mean"]) / model["scale"]
    return np.hstack([np.maximum(y @ model["hidden"] + model["bias"], 0), y, np.ones((len(x), 1))])


def probabilities(x: np.ndarray, model: dict) -> np.ndarray:
    return _softmax(_inputs(x, model) @ model["weights"])


def fit(vectors: DataFrame, rows: int, k: int = 10, sample: int = SAMPLE) -> dict | None:
    """The router: learnt on the driver from at most ``sample`` vectors."""
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if not len(picked):
        return None
    lengths = picked["v"].map(len)
    dims = int(lengths.mode().max())
    x = np.stack(picked["v"][lengths == dims].to_numpy()).astype(np.float64)
    parts = int(min(max(-(-rows // PART_ROWS), FEWEST_PARTS), MOST_PARTS, max(1, len(x) // 4)))
    scale = max(float(x.std()), 1e-300)
    random = np.random.default_rng(3)
    model = {"dims": dims, "parts": parts, "mean": x.mean(0), "scale": scale,
             "hidden": random.normal(size=(dims, 128)) / np.sqrt(dims), "bias": random.normal(size=128) * 0.3}
    inputs = _inputs(x, model)
    model["weights"] = np.zeros((inputs.shape[1], parts))
    model["probes"] = parts
    if parts == 1 or len(x) <= k + 1:
        return model
    near = _graph(x, min(DEGREE, len(x) - 1))
    label = balanced_parts(x, near, parts)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].ravel()), 1.0 / (near.shape[1] + 2))
    soft[np.arange(len(x)), label] += 2.0 / (near.shape[1] + 2)
    w, m, s = model["weights"], 0.0, 0.0
    for step in range(1, 201):
        g = inputs.T @ (_softmax(inputs @ w) - soft) / len(x) + 1e-5 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    model["weights"] = w
    p = probabilities(x, model)
    home, ranks = p.argmax(1), np.argsort(np.argsort(-p, axis=1), axis=1)
    depth = ranks[np.arange(len(x))[:, None], home[near]]  # how many parts deep each true neighbour lies
    model["probes"] = int(np.searchsorted(np.cumsum(np.bincount(depth.ravel(), minlength=parts)) / depth.size, RECALL) + 1)
    return model


def search(vectors: DataFrame, queries: DataFrame, space: Workspace, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found; both inputs are (vec_id, v) from ``usable``."""
    spark = vectors.sparkSession
    model = fit(vectors, vectors.count(), k)
    empty = "query_id long, rank int, vec_id long, score double"
    if model is None:
        return spark.createDataFrame([], empty)
    shared = spark.sparkContext.broadcast(model)

    def assign(frames):
        model = shared.value
        for pdf in frames:
            if len(pdf):
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"],
                                    "part": probabilities(np.stack(pdf["v"].to_numpy()), model).argmax(1)})

    fitting = F.size("v") == model["dims"]
    index = space.keep(vectors.where(fitting).mapInPandas(assign, "vec_id long, v array<double>, part int"), "index")
    size = {r.part: r["count"] for r in index.groupBy("part").count().collect()}  # a row per part
    counts = np.array([size.get(p, 0) for p in range(model["parts"])])

    def route(frames):
        model = shared.value
        for pdf in frames:
            if not len(pdf):
                continue
            order = np.argsort(-probabilities(np.stack(pdf["v"].to_numpy()), model), axis=1, kind="stable")
            reach = (np.cumsum(counts[order], axis=1) < k + 1).sum(1) + 1  # parts needed for k candidates
            take = np.minimum(np.maximum(reach, model["probes"]), len(counts))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"],
                                "parts": [order[i, :t].astype(np.int32) for i, t in enumerate(take)]})

    asked = queries.where(fitting).mapInPandas(route, "vec_id long, v array<double>, parts array<int>")
    asked = space.keep(asked.select("vec_id", "v", F.explode("parts").alias("part")), "asked")
    wanted = {r.part: r["count"] for r in asked.groupBy("part").count().collect()}
    blocks = F.create_map(*[F.lit(x) for p, n in sorted(size.items()) for x in (p, -(-n // BLOCK_ROWS))]) if size else None
    if not size or not wanted:
        return spark.createDataFrame([], empty)
    chunks = F.create_map(*[F.lit(x) for p, n in sorted(wanted.items()) for x in (p, -(-n // BLOCK_QUERIES))])
    mine = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks[F.col("part")])).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(chunks[F.col("part")], F.lit(1)).cast("long") - 1)))
    theirs = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), chunks[F.col("part")])).where(
        blocks[F.col("part")].isNotNull()).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), blocks[F.col("part")].cast("long") - 1)))

    def nearest(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            x, ids = np.stack(rows["v"].to_numpy()), rows["vec_id"].to_numpy()
            norm = (x * x).sum(1)
            for q, v in zip(asked["vec_id"].to_numpy(), np.stack(asked["v"].to_numpy())):
                rough = norm - 2 * (x @ v) + v @ v
                rough[ids == q] = np.inf
                last = min(k, len(x)) - 1
                limit = np.partition(rough, last)[last]
                close = np.flatnonzero((rough <= limit + 1e-9 * (abs(limit) + norm.max() + v @ v)) & np.isfinite(rough))
                exact = np.sqrt(((x[close] - v) ** 2).sum(1))
                best = np.lexsort((ids[close], exact))[:k]
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[close][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64"})

    keys = ["part", "block", "chunk"]
    found = mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(nearest, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
