"""Language-model scores: a causal self-attention model over subword ids, and a smoothed word model as base.

The attention model has one block (attention over the last ``WINDOW`` ids, then a
small feed-forward layer) and predicts an id in two steps, its class and the id
within the class; the most frequent ids are classes of their own, the others share
classes by frequency. It learns from every id of every training document: in each of
``ROUNDS`` every task goes on from the common network with its share of the
windows of its own rows, and the networks are averaged by their windows, a few at
a time in further tasks. The rounds together take each window once, so steps grow
with the corpus and no gradient travels. Only the weights that the first round
begins with, which would be random otherwise, come from a short run over a few
documents; no count, class or bias does.
An id that training documents lack shares a small part of the last class. A text is read in
overlapping windows of ``WINDOW`` ids, each id scored once, with at least
``CONTEXT`` ids of context once there are so many. Texts are cut into ids once;
the written ids hold them without loss, and both models read them from there.

The base counts lower-cased words and one end per training document. Counts of
frequent words (at most ``BROADCAST_WORDS``, 16 bytes each) travel to the tasks;
all other words of a text are looked up by a join.

Defined cases: null and empty texts are the end alone; without training documents
both scores follow from zero counts; repeated rows get equal scores; words are
told apart by 64-bit hashes. Only doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common as C
from ledgerloom.llm.tokens import VOCABULARY, Encoder, read_ranks

WINDOW, CONTEXT, WIDTH, HIDDEN, CLASSES = 48, 12, 24, 48, 192
#: The weights before the first round: this many steps on at most this many documents, those with the smallest hash of the id.
TRAIN_DOCUMENTS, STEPS, BATCH = 1500, 500, 64
#: Learning rate of each round, and the windows of text for each window learnt from over all rounds: every one.
ROUNDS, SPAN = (3e-3, 1e-3), 1
#: Networks averaged in one task, and ids a task holds to draw windows from.
FAN, HELD_IDS = 64, 1 << 20
BROADCAST_WORDS = 1 << 20
#: Windows worked on at once.
TOGETHER = 48


# -------------------------------------------------------------------- network

def _start(random: np.random.Generator, slots: int = 0) -> dict[str, np.ndarray]:
    """Random weights; ``slots`` ids share classes and have an input row (``ein``) and an output row (``in``) each."""
    def normal(*shape, scale=1.0):
        return (random.normal(size=shape) * scale / np.sqrt(shape[0])).astype(np.float32)

    d = WIDTH
    return {"emb": normal(CLASSES, d, scale=2.0), "pos": normal(WINDOW, d, scale=0.5), "q": normal(d, d), "k": normal(d, d),
            "v": normal(d, d), "o": normal(d, d), "w1": normal(2 * d, HIDDEN), "b1": np.zeros(HIDDEN, np.float32),
            "w2": normal(HIDDEN, d), "u": normal(d, CLASSES), "b": np.zeros(CLASSES, np.float32),
            "ein": np.zeros((slots + 1, d), np.float32), "in": np.zeros((slots, d), np.float32)}


#: Scores are kept in a range whose exponentials fit, instead of subtracting each row's largest.
_FAR = 60
_ONES = np.ones(max(WINDOW, CLASSES), np.float32)
_SEES = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def _forward(p: dict, x: np.ndarray, slot: np.ndarray | None = None) -> dict:
    """Activations for class windows ``x`` (batch, WINDOW) and their slots; place t sees places up to t."""
    e = p["emb"][x] + p["pos"]
    if slot is not None:
        e = e + p["ein"][slot]
    q, k, v = e @ p["q"], e @ p["k"], e @ p["v"]
    a = q @ k.transpose(0, 2, 1)
    a *= np.float32(1 / np.sqrt(WIDTH))
    np.clip(a, -_FAR, _FAR, out=a)
    np.exp(a, out=a)
    a *= _SEES
    a /= (a @ _ONES[:WINDOW])[..., None]
    m = a @ v
    c = np.concatenate([e, m @ p["o"]], 2)
    h = np.maximum(c @ p["w1"] + p["b1"], 0)
    y = c[..., :WIDTH] + c[..., WIDTH:] + h @ p["w2"]
    return {"e": e, "q": q, "k": k, "v": v, "a": a, "m": m, "c": c, "h": h, "y": y}


def _log_softmax_at(p: dict, y: np.ndarray, target: np.ndarray) -> np.ndarray:
    z = y @ p["u"]
    np.clip(z, -_FAR, _FAR, out=z)
    own = z[np.arange(len(z)), target] + p["b"][target]
    np.exp(z, out=z)
    return own - np.log(z @ np.exp(p["b"]))


def _merged(p: dict) -> dict:
    """The network with products of matrices that meet no non-linear step between them."""
    return {**p, "qk": p["q"] @ p["k"].T / np.float32(np.sqrt(WIDTH)), "vo": p["v"] @ p["o"]}


def _groups(slot: np.ndarray, cut: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """The places of each shared class among ``slot``, and the class's first and last slot."""
    order = np.argsort(slot, kind="stable")
    at = np.searchsorted(slot[order], cut)
    for k in np.flatnonzero(np.diff(at)):
        yield order[at[k]: at[k + 1]], cut[k], cut[k + 1]


def _log_within(p: dict, y: np.ndarray, slot: np.ndarray, plan: dict) -> np.ndarray:
    """The log probability of each slot within its class."""
    out = np.empty(len(slot))
    for some, a, b in _groups(slot, plan["cut"]):
        z = y[some] @ p["in"][a:b].T + plan["bias"][a:b]
        z -= z.max(1, keepdims=True)
        own = z[np.arange(len(some)), slot[some] - a]
        out[some] = own - np.log(np.exp(z).sum(1))
    return out


def _log_of(p: dict, x: np.ndarray, first: int, wanted: np.ndarray, target: np.ndarray,
            slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The log probabilities of classes ``target`` after the wanted places of windows ``x``, and the last activations
    there; places before ``first`` are only looked at."""
    e = np.take(p["emb"], x, axis=0)
    e += p["pos"]
    if slot is not None:
        e += np.take(p["ein"], slot, axis=0)
    own = e[:, first:]
    a = (own @ p["qk"]) @ e.transpose(0, 2, 1)
    np.clip(a, -_FAR, _FAR, out=a)
    np.exp(a, out=a)
    a *= _SEES[first:]
    m = a @ (e @ p["vo"])
    m /= (a @ _ONES[:WINDOW])[..., None]
    c = np.concatenate([own, m], 2)[wanted]
    h = c @ p["w1"]
    h += p["b1"]
    np.maximum(h, 0, out=h)
    y = h @ p["w2"]
    y += c[:, :WIDTH]
    y += c[:, WIDTH:]
    return _log_softmax_at(p, y, target), y


def _added(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The sums of the rows that share a place in ``at``, at their places of ``size``."""
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    out[at[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _gradients(p: dict, x: np.ndarray, target: np.ndarray, slots: np.ndarray | None = None, plan: dict | None = None) -> dict:
    """Gradients of the mean loss of windows; ``slots`` (batch, WINDOW + 1) are those of the places and of what follows."""
    f = _forward(p, x, None if slots is None else slots[:, :-1])
    flat_y, flat_target, share = f["y"].reshape(-1, WIDTH), target.ravel(), f["y"].dtype.type(1 / target.size)
    flat = np.empty_like(flat_y)
    g = {"u": np.zeros_like(p["u"]), "b": np.zeros_like(p["b"])}
    for a in range(0, len(flat), TOGETHER * 16):  # so few that their classes stay in the cache
        y = flat_y[a: a + TOGETHER * 16]
        z = y @ p["u"]
        z += p["b"]
        np.clip(z, -_FAR, _FAR, out=z)
        np.exp(z, out=z)
        z *= (share / (z @ _ONES[:CLASSES]))[:, None]
        z[np.arange(len(z)), flat_target[a: a + len(z)]] -= share
        g["u"] += y.T @ z
        g["b"] += z.sum(0)
        np.matmul(z, p["u"].T, out=flat[a: a + len(z)])
    dy = flat.reshape(f["y"].shape)

    def outer(a, b):
        return a.reshape(-1, a.shape[-1]).T @ b.reshape(-1, b.shape[-1])

    g["in"], g["ein"] = np.zeros_like(p["in"]), np.zeros_like(p["ein"])
    if slots is not None:
        follows = slots[:, 1:].ravel()
        shared = np.flatnonzero(follows < len(p["in"]))
        for some, a, b in _groups(follows[shared], plan["cut"]):
            some = shared[some]
            y = flat_y[some]
            w = y @ p["in"][a:b].T
            w += plan["bias"][a:b]
            w -= w.max(1, keepdims=True)
            np.exp(w, out=w)
            w *= (share / w.sum(1))[:, None]
            w[np.arange(len(some)), follows[some] - a] -= share
            g["in"][a:b] = w.T @ y
            flat[some] += w @ p["in"][a:b]
    g["w2"] = outer(f["h"], dy)
    dh = dy @ p["w2"].T
    dh *= f["h"] > 0
    g["w1"], g["b1"] = outer(f["c"], dh), dh.sum((0, 1))
    dc = dh @ p["w1"].T
    de, dmo = dc[..., :WIDTH] + dy, dc[..., WIDTH:] + dy
    g["o"] = outer(f["m"], dmo)
    dm = dmo @ p["o"].T
    ds, dv = dm @ f["v"].transpose(0, 2, 1), f["a"].transpose(0, 2, 1) @ dm
    ds -= (dm * f["m"]).sum(2, keepdims=True)
    ds *= f["a"]
    ds *= np.float32(1 / np.sqrt(WIDTH))
    dq, dk = ds @ f["k"], ds.transpose(0, 2, 1) @ f["q"]
    for name, part in (("q", dq), ("k", dk), ("v", dv)):
        g[name] = outer(f["e"], part)
        de += part @ p[name].T
    g["pos"] = de.sum(0)
    rows = de.reshape(-1, WIDTH)
    g["emb"] = _added(rows, x.ravel(), CLASSES)
    if slots is not None:
        seen = slots[:, :-1].ravel()
        some = np.flatnonzero(seen < len(p["in"]))  # the others have a class of their own
        if len(some):
            g["ein"] = _added(rows[some], seen[some], len(p["ein"]))
    return g


class Trainer:
    """Adam over random windows of lines of ids; weights are changed in place."""

    def __init__(self, p: dict[str, np.ndarray], plan: dict, random: np.random.Generator):
        self.p, self.plan, self.random, self.steps = p, plan, random, 0
        self.m = {n: np.zeros_like(w) for n, w in p.items()}
        self.s = {n: np.zeros_like(w) for n, w in p.items()}

    def step(self, line: np.ndarray, rate: float, places: np.ndarray | None = None) -> None:
        """One step on windows at some places of a line longer than a window, or at random ones."""
        self.steps += 1
        if places is None:
            places = self.random.integers(0, len(line) - WINDOW, BATCH)
        cut = line[places[:, None] + np.arange(WINDOW + 1)]
        kinds, slots = self.plan["kind"][cut], self.plan["slot"][cut]
        rate *= min(1, self.steps / 30)
        for n, g in _gradients(self.p, kinds[:, :-1], kinds[:, 1:], slots, self.plan).items():
            self.m[n] += 0.1 * (g - self.m[n])
            self.s[n] += 0.01 * (g * g - self.s[n])
            self.p[n] -= (rate * (self.m[n] / (1 - 0.9**self.steps)) / (np.sqrt(self.s[n] / (1 - 0.99**self.steps)) + 1e-8)).astype(np.float32)


def _long_enough(line: np.ndarray) -> np.ndarray:
    return line if len(line) > WINDOW else np.tile(line, WINDOW // len(line) + 2)


def train_start(streams: list[np.ndarray], plan: dict, seed: int = 11) -> dict[str, np.ndarray]:
    """A network from random windows of streams of ids, each ending with the end's id."""
    random = np.random.default_rng(seed)
    trainer = Trainer(_start(random, len(plan["bias"])), plan, random)
    line = _long_enough(np.concatenate(streams))
    for step in range(1, STEPS + 1):
        trainer.step(line, 6e-3 * (1 - 0.5 * step / STEPS))
    return trainer.p


def log_probabilities(p: dict, classes: np.ndarray, starts: np.ndarray, end: int, slots: np.ndarray | None = None,
                      plan: dict | None = None) -> np.ndarray:
    """The natural log probability of each class in its text, and with ``slots`` of each id; texts begin at ``starts``
    and end with the end's class."""
    stride = WINDOW - CONTEXT
    size = np.diff(starts)
    windows = np.maximum(1, -(-(size - CONTEXT) // stride))
    text = np.repeat(np.arange(len(size)), windows)
    number = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = number[:, None] * stride + np.arange(WINDOW)  # within the text
    inside = place < size[text][:, None]
    fresh = inside & ((number[:, None] == 0) | (np.arange(WINDOW) >= CONTEXT))
    target_at = starts[text][:, None] + np.where(inside, place, 0)
    before = np.where(place > 0, np.minimum(target_at, len(classes)) - 1, 0)
    seen = np.where(place > 0, classes[before], end)
    seen_slots = None if slots is None else np.where(place > 0, slots[before], len(p["in"]))
    out, p, later = np.zeros(len(classes)), _merged(p), []

    def settle():
        if later:
            at, y = (np.concatenate(part) for part in zip(*later))
            out[at] += _log_within(p, y, slots[at], plan)
            later.clear()

    for first, group in ((0, np.flatnonzero(number == 0)), (CONTEXT, np.flatnonzero(number > 0))):
        for a in range(0, len(group), TOGETHER):  # so few that their activations stay in the cache
            some = group[a: a + TOGETHER]
            mine = fresh[some, first:]
            at = target_at[some, first:][mine]
            out[at], y = _log_of(p, seen[some], first, mine, classes[at], None if slots is None else seen_slots[some])
            if slots is not None:
                shared = slots[at] < len(p["in"])
                later.append((at[shared], y[shared]))
                if len(later) == 64:
                    settle()
    settle()
    return out


# --------------------------------------------------------------------- corpus

def _coded(ranks):
    """Each row as its subword ids (kind 3), and of the rows to learn from the counts of a stretch of the task:
    (kind, h, c) of word hashes (0), subword ids (1) and ends (2)."""
    names = ["kind", "h", "c", "doc_id", "learn", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(ranks.value)
        total, words, held, ends = np.zeros(coder.end + 1, np.int64), [], 0, 0

        def rows(kind, h, c):
            none = pa.nulls
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(h), kind, np.int32)), pa.array(h, pa.int64()), pa.array(c, pa.int64()),
                 none(len(h), pa.int64()), none(len(h), pa.bool_()), none(len(h), pa.binary())], names)

        def flush():
            h, c = np.unique(np.concatenate(words), return_counts=True)
            return rows(0, C.signed(h), c)

        for batch in batches:
            learn = batch.column("learn")
            for texts in C.text_chunks(batch.column("text").filter(learn)):
                starts, stops, _ = C.word_bounds(texts)
                words.append(C.run_hashes(C.lower_ascii(texts.data), starts, stops))
                held += len(words[-1])
                ends += len(texts)
                if held > 4_000_000:
                    yield flush()
                    words, held = [], 0
            for texts in C.text_chunks(batch.column("text")):
                at, size = texts.rows[0], len(texts)
                coded = [coder.ids(batch.column("text")[i].as_py() or "") for i in texts.rows]
                mine = [ids for ids, own in zip(coded, learn.slice(at, size).to_pylist()) if own]
                total += np.bincount(np.concatenate([np.zeros(0, np.uint16), *mine]), minlength=len(total))
                none = pa.nulls(size, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, 3, np.int32)), none, none, batch.column("doc_id").slice(at, size).cast(pa.int64()),
                     learn.slice(at, size), pa.array([ids.tobytes() for ids in coded], pa.binary())], names)
        if held:
            yield flush()
        at = np.flatnonzero(total)
        yield rows(1, at, total[at])
        yield rows(2, np.array([coder.end]), np.array([ends]))

    return run


def _stretches(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of ids in stretches of about ``CHUNK_BYTES``, or one longer row, and where each begins."""
    held, first, size = [], 0, 0
    for i, value in enumerate(column):
        held.append(np.frombuffer(value.as_buffer(), np.uint16))
        size += held[-1].nbytes
        if size > C.CHUNK_BYTES // 2:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


def _classes(ids: np.ndarray) -> dict[str, np.ndarray]:
    """From counts of ids, the end's last: ``kind``, the class of each id; ``slot``, its row if it shares a class, else
    the number of rows; ``cut``, the bounds of the shared classes among the rows; ``bias``, the log count of each row;
    ``more``, what is added to the log probability of an id, which is all of it in the class for ids never seen."""
    order = np.argsort(-ids[:-1], kind="stable")
    own = CLASSES * 3 // 4
    rest = order[own:]
    rest, unseen = rest[ids[rest] > 0], order[ids[order] == 0]
    kind, slot = np.full(len(ids), CLASSES - 1), np.full(len(ids), len(rest))
    kind[-1] = 0
    kind[order[:own]] = np.arange(1, len(order[:own]) + 1)
    mass = np.cumsum(ids[rest])
    group = np.minimum((mass / mass[-1] * (CLASSES - own - 1)).astype(np.int64), CLASSES - own - 2) if len(rest) else mass.astype(np.int64)
    kind[rest], slot[rest] = own + 1 + group, np.arange(len(rest))
    kind[unseen] = CLASSES - 1
    more = np.zeros(len(ids))
    last = kind == CLASSES - 1
    if len(unseen):
        lost = 0.5 * len(unseen) / (ids[last].sum() + 0.5 * len(unseen))
        more[last] = np.log1p(-lost) if ids[last].any() else 0
        more[unseen] = np.log(lost / len(unseen))
        slot[unseen] = len(rest)
    return {"kind": kind, "slot": slot, "cut": np.searchsorted(group, np.arange(CLASSES - own)), "more": more,
            "bias": np.log(ids[rest]).astype(np.float32)}


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in sorted(p)])


def _unflat(row: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    parts = np.split(row, np.cumsum([like[n].size for n in sorted(like)])[:-1])
    return {n: part.reshape(like[n].shape).astype(np.float32) for n, part in zip(sorted(like), parts)}


_NETWORK = "windows long, weights binary"


def _network_row(windows: int, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([windows], pa.int64()), pa.array([weights.astype(np.float32).tobytes()], pa.binary())],
                                      ["windows", "weights"])


def _places(size: int, turn: int, random: np.random.Generator) -> np.ndarray:
    """Where the windows of a turn begin in a line longer than a window, in random order; those of all turns hold every id
    but the line's first as one to predict."""
    places = np.minimum(np.arange(0, size - 1, WINDOW * SPAN), size - 1 - WINDOW)[turn::len(ROUNDS)]
    return random.permutation(places)


def _learn(shared, rate: float, turn: int, end: int):
    """The network after the turn's windows of the task's rows; the rate falls to a tenth along each stretch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, plan = shared.value
        trainer = Trainer({n: w.copy() for n, w in net.items()}, plan, np.random.default_rng([turn, TaskContext.get().partitionId()]))
        first = np.array([end], np.uint16)  # what a text's first id follows
        held, size, windows = [first], 0, 0

        def learn():
            line = _long_enough(np.concatenate(held))
            places = _places(len(line), turn, trainer.random)
            for a in range(0, len(places), BATCH):
                trainer.step(line, rate * (1 - 0.9 * a / len(places)), places[a: a + BATCH])
            return len(places)

        for batch in batches:
            for ids in batch.column("ids"):
                held.append(np.append(np.frombuffer(ids.as_buffer(), np.uint16), np.uint16(end)))
                size += len(held[-1])
                if size >= HELD_IDS:
                    windows += learn()
                    held, size = [first], 0
        if size:
            windows += learn()
        if windows:
            yield _network_row(windows, _flat(trainer.p))

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of the networks of a task by their windows, one held at a time."""
    total, windows = None, 0
    for batch in batches:
        for n, weights in zip(batch.column("windows").to_pylist(), batch.column("weights")):
            row = np.frombuffer(weights.as_buffer(), np.float32) * np.float64(n)
            total = row if total is None else total + row
            windows += n
    if windows:
        yield _network_row(windows, total / windows)


def _trained(rows: DataFrame, start: dict[str, np.ndarray], plan: dict, end: int, space: C.Workspace) -> dict[str, np.ndarray]:
    """``start`` after the rounds over all ``rows`` (ids)."""
    net = start
    for turn, rate in enumerate(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast((net, plan))
        nets = space.keep(rows.mapInArrow(_learn(shared, rate, turn, end), _NETWORK), f"nets{turn}")
        n = nets.count()
        while n > 1:
            n = -(-n // FAN)
            nets = nets.repartition(n).mapInArrow(_average, _NETWORK)
        got = nets.toArrow()
        if got.num_rows:
            net = _unflat(np.frombuffer(got["weights"][0].as_py(), np.float32), start)
        space.drop(f"nets{turn}")
        shared.destroy()
    return net


def _score(shared, known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (hashes, counts), (ends, n, v) = shared.value, known.value[0], known.value[1]
        coder = Encoder(model["ranks"])
        scale = np.log10(n + 0.5 * (v + 1))
        part, row = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for began, held in _stretches(batch.column("ids")):
                plain = pa.array([coder.encoded(ids) for ids in held], pa.large_binary()).cast(pa.large_string())
                texts = next(C.text_chunks(plain, 1 << 40, len(plain)))
                size = len(held)
                starts, stops, first = C.word_bounds(texts)
                h = C.signed(C.run_hashes(C.lower_ascii(texts.data), starts, stops))
                doc = np.repeat(np.arange(size), np.diff(first))
                at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
                hit = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
                base = np.bincount(doc[hit], np.log10(counts[at[hit]] + 0.5) - scale, minlength=size)
                base += np.log10(ends + 0.5) - scale
                certain = np.bincount(doc[hit], minlength=size) + (ends > 0)
                coded = [np.append(ids, coder.end).astype(np.int64) for ids in held]
                begins = np.concatenate(([0], np.cumsum([len(c) for c in coded])))
                ids = np.concatenate(coded)
                if model["net"] is None:
                    logs = np.full(len(ids), -np.log(coder.end + 1.0))
                else:
                    plan = model["plan"]
                    logs = log_probabilities(model["net"], plan["kind"][ids], begins, 0, plan["slot"][ids], plan) + plan["more"][ids]
                score = np.add.reduceat(logs, begins[:-1]) / np.log(10)
                rows = part + row + np.arange(size)
                row += size
                lost = np.flatnonzero(~hit)
                lost = lost[np.lexsort((h[lost], doc[lost]))]
                new = np.ones(len(lost), bool)
                new[1:] = (np.diff(doc[lost]) != 0) | (h[lost][1:] != h[lost][:-1])
                keys = doc[lost][new], h[lost][new]
                times = np.diff(np.append(np.flatnonzero(new), len(lost)))
                m = len(times)
                none = pa.nulls
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((rows, rows[keys[0]]))),
                     pa.concat_arrays([doc_ids.slice(began, size), none(m, pa.int64())]),
                     pa.concat_arrays([pa.array(np.diff(first) + 1, pa.int64()), none(m, pa.int64())]),
                     pa.concat_arrays([pa.array(certain, pa.int64()), none(m, pa.int64())]),
                     pa.concat_arrays([pa.array(base), none(m, pa.float64())]),
                     pa.concat_arrays([pa.array(score), none(m, pa.float64())]),
                     pa.concat_arrays([none(size, pa.int64()), pa.array(keys[1], pa.int64())]),
                     pa.concat_arrays([none(size, pa.int64()), pa.array(times, pa.int64())])],
                    ["row", "doc_id", "n_tokens", "certain", "base", "score", "h", "times"])

    return run


def scores(documents: DataFrame, training: Column, space: C.Workspace, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score); ``training`` says which rows are learnt from."""
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    coded = space.keep(documents.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("learn")).mapInArrow(
        _coded(ranks), "kind int, h long, c long, doc_id long, learn boolean, ids binary"), "coded")
    rows = coded.where("kind = 3")
    sums = space.keep(coded.where("kind < 3").groupBy("kind", "h").agg(F.sum("c").alias("c")), "counts")
    words = sums.where("kind = 0").select("h", "c")
    # by doublings of the count: at most 64 rows
    steps = words.groupBy(F.floor(F.log2("c")).cast("int").alias("s")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    cut, most = 64, 0
    for r in sorted(steps, key=lambda r: -r.s):
        if most + r.n > BROADCAST_WORDS:
            break
        cut, most = r.s, most + r.n
    frequent = words.where(F.col("c") >= 2**cut if cut < 62 else F.lit(False)).toArrow().sort_by("h")
    subwords = {r.h: r.c for r in sums.where("kind = 1").collect()}  # bounded by the vocabulary
    ends = sum(r.c for r in sums.where("kind = 2").collect())
    n, v = sum(r.c for r in steps) + ends, sum(r.n for r in steps) + (ends > 0)

    model = {"ranks": ranks.value, "net": None}
    if ends:
        coder = Encoder(ranks.value)
        ids = np.zeros(coder.end + 1)
        ids[list(subwords)] = list(subwords.values())
        ids[-1] = ends
        plan = model["plan"] = _classes(ids)
        learnt = rows.where("learn").select("doc_id", "ids")
        sample = learnt.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCUMENTS).toArrow()
        order = sorted(zip(((-1 if i is None else i) for i in sample["doc_id"].to_pylist()), sample["ids"].to_pylist()))
        streams = [np.append(np.frombuffer(t, np.uint16).astype(np.int64), coder.end) for _, t in order]
        model["net"] = _trained(learnt.select("ids"), train_start(streams, plan), plan, coder.end, space)
    shared = spark.sparkContext.broadcast(model)
    known = spark.sparkContext.broadcast(((frequent["h"].to_numpy(), frequent["c"].to_numpy()), (ends, n, v)))
    got = space.keep(rows.select("doc_id", "ids").mapInArrow(
        _score(shared, known), "row long, doc_id long, n_tokens long, certain long, base double, score double, h long, times long"), "scored")
    scale = float(np.log10(n + 0.5 * (v + 1)))
    rare = got.where("h IS NOT NULL").select("row", "h", "times").join(words, "h", "left").groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - scale)).alias("more"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("found"))
    return got.where("h IS NULL").select("row", "doc_id", "n_tokens", "certain", "base", "score").join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("certain") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
