"""Repair of a conversation's turn structure by the cheapest edits.

A repaired conversation is empty, or an optional system turn followed by pairs
of a user's and an assistant's turn, told by the first letters of the roles.
Keep costs nothing, Rerole 3, Insert (an empty turn) 3, Delete 4; blank and
repeated turns have to be deleted, and a truncated turn that stays costs 3 more.
Among the cheapest repairs the one whose edits spell the least word wins (D < I
< K < R, a beginning before what continues it).

Each edit is an edge of a graph whose nodes are (turns read, what came last), and
its weight one integer: the high digits are the cost, below them one digit of
``DIGIT`` bits per edit, in its place in the word, and zeros to the end. So the
least sum of weights is the cheapest repair with the least word, and integer
comparison is all the search needs. Insertions are placed before the turn they
precede, so of two words that reach one node none begins the other and a common
end never turns their order.

Conversations are read as sorted streams, one task each (a digest runs through
its turns in order), and texts are never held: every live node carries the digest
of its repaired text so far. After ``BLOCK`` turns the four words are cut off
into a shared list and their order becomes the first digit of what follows, which
bounds the integers. A conversation of any length costs the length of its words.

Repeats inside a conversation are found by a window over (conversation, role,
text), whose rows stream too; a role and text that recur have one partition.

Defined cases: a null role or text is one space, and a null turn comes first; a
null conv_id is a conversation of its own; equal rows of one turn are repeats of
each other; rows of one turn are ordered by role and text; a conversation all of
whose rows were dropped has zeros, an empty word and the digest of nothing; other
columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, DIGIT = 64, 3
KEEP, REROLE, INSERT, DELETE, CUT_OFF = 0, 3, 3, 4, 3
#: Letters of the audit word; digits in ASCII order, 0 for none.
LETTERS = " DIKR"
_D, _I, _K, _R = 1, 2, 3, 4
#: What came last: nothing, the system turn, a user's, an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {("s", NOTHING): SYSTEM} | {("u", a): USER for a in (NOTHING, SYSTEM, ASSISTANT)} | {("a", USER): ASSISTANT}
#: A block's word has at most three insertions and one edit per turn, the rank of what came before, and the last insertions.
_PLACES = 4 * BLOCK + 5
_HIGH = DIGIT * _PLACES

BLANK, REPEATED, TRUNCATED = "blank", "duplicate", "truncated"
_SOLID = r"[^\x20\x09-\x0D]"


# ------------------------------------------------------------------------ rows

def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost): the rows after the damage their keys call for; dropped rows stay, marked as lost."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("lost"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def first_fault(text: Column, repeat: Column) -> Column:
    """The first of blank, duplicate and truncated that holds, else null."""
    return (F.when(~text.rlike(_SOLID), BLANK).when(repeat, REPEATED)
            .when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED))


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``; lost rows take no part in it."""
    seen = Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    numbered = rows.withColumn("__n", F.row_number().over(seen))
    return numbered.withColumn("fault", F.when(~F.col("lost"), first_fault(F.col("text"), F.col("__n") > 1))).drop("__n")


# ---------------------------------------------------------------------- repair

class _Path:
    """The best way to a node: its weight, the edits in the open block, the blocks before, and the repaired text's digest."""

    __slots__ = ("weight", "places", "before", "digest", "started")

    def __init__(self, weight, places, before, digest, started):
        self.weight, self.places, self.before, self.digest, self.started = weight, places, before, digest, started

    def step(self, cost: int, letter: int) -> _Path:
        """One edit further; the digest is shared until ``wrote``."""
        weight = self.weight + (cost << _HIGH) + (letter << (_HIGH - DIGIT * (self.places + 1)))
        return _Path(weight, self.places + 1, self.before, self.digest, self.started)

    def wrote(self, role: str, text: str) -> _Path:
        self.digest = self.digest.copy()
        self.digest.update((("\n" if self.started else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.started = True
        return self

    def word(self) -> str:
        """The letters of the open block (its first place is a rank)."""
        return "".join(LETTERS[(self.weight >> (_HIGH - DIGIT * (i + 1))) & 7] for i in range(1, self.places))


def _keep_least(nodes: dict[int, list], state: int, path: _Path, role: str | None, text: str) -> None:
    """Of the ways to a node the one of least weight; what it writes is digested when the node is settled."""
    held = nodes.get(state)
    if held is None or path.weight < held[0].weight:
        nodes[state] = [path, role, text]


def _settled(nodes: dict[int, list]) -> dict[int, _Path]:
    return {s: path if role is None else path.wrote(role, text) for s, (path, role, text) in nodes.items()}


def _with_insertions(paths: dict[int, _Path]) -> dict[int, _Path]:
    """The nodes reached by up to three insertions (more would only come back)."""
    nodes = {s: [p, None, ""] for s, p in paths.items()}
    layer = dict(paths)
    for _ in range(3):
        reached: dict[int, list] = {}
        for state, path in layer.items():
            _keep_least(reached, _NEXT[state], path.step(INSERT, _I), _ROLE[_NEXT[state]], "")
        layer = _settled(reached)
        for state, path in layer.items():
            _keep_least(nodes, state, path, None, "")
    return {s: p for s, (p, _, _) in nodes.items()}


class Repair:
    """One conversation, turn after turn."""

    def __init__(self):
        self.paths = {NOTHING: _Path(0, 1, None, hashlib.sha256(), False)}
        self.read = 0

    def add(self, role: str, text: str, fault: str | None) -> None:
        if self.read == BLOCK:
            self._close_block()
        self.read += 1
        extra = CUT_OFF if fault == TRUNCATED else 0
        nodes: dict[int, list] = {}
        for state, path in _with_insertions(self.paths).items():
            _keep_least(nodes, state, path.step(DELETE, _D), None, "")
            if fault in (BLANK, REPEATED):
                continue
            kept = _KEPT.get((role[:1], state))
            if kept is not None:
                _keep_least(nodes, kept, path.step(KEEP + extra, _K), role, text)
            other = _NEXT[state]
            _keep_least(nodes, other, path.step(REROLE + extra, _R), _ROLE[other], text)
        self.paths = _settled(nodes)

    def _close_block(self) -> None:
        order = sorted(self.paths.values(), key=lambda p: p.weight & ((1 << _HIGH) - 1))
        for rank, path in enumerate(order):
            path.before = (path.before, path.word())
            path.weight = (path.weight >> _HIGH << _HIGH) + (rank << (_HIGH - DIGIT))
            path.places = 1
        self.read = 0

    def result(self) -> tuple[int, str, str]:
        """(cost, audit word, digest of the repaired conversation)."""
        ends = _with_insertions(self.paths)
        best = min((ends[s] for s in (NOTHING, ASSISTANT) if s in ends), key=lambda p: p.weight)
        words, before = [best.word()], best.before
        while before is not None:
            words.append(before[1])
            before = before[0]
        return best.weight >> _HIGH, "".join(reversed(words)), best.digest.hexdigest()


_NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_KINDS = [pa.int64()] * 7 + [pa.string()] * 2
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    def __init__(self):
        self.repair, self.faults, self.illegal = Repair(), {BLANK: 0, REPEATED: 0, TRUNCATED: 0}, 0
        self.least = self.most = self.last = None
        self.turns = 0

    def add(self, turn, role, text, fault):
        if fault is not None:
            self.faults[fault] += 1
        if self.last is not None and self.last + role[:1] not in _LEGAL:
            self.illegal += 1
        self.last = role[:1]
        if turn is not None and turn != self.most:  # turns come in order
            self.least = turn if self.least is None else self.least
            self.most, self.turns = turn, self.turns + 1
        self.repair.add(role, text, fault)

    def row(self, conv):
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (conv, gaps, self.faults[BLANK], self.faults[REPEATED], self.faults[TRUNCATED], self.illegal, *self.repair.result())


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, done = None, None, []

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), _KINDS)], _NAMES)
        done.clear()
        return out

    for batch in batches:
        for conv, turn, role, text, fault, lost in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (conv,):
                if now is not None:
                    done.append(state.row(now[0]))
                now, state = (conv,), _Conversation()
            if not lost:
                state.add(turn, role, text, fault)
        if done:
            yield rows()
    if now is not None:
        done.append(state.row(now[0]))
        yield rows()


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``damaged`` rows: its gaps, faults, the cost and word of its edits, a digest of the result."""
    turns = with_faults(rows).select("conv_id", "turn", "role", "text", "fault", "lost")
    ordered = turns.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text",
        F.coalesce(F.col("fault") == REPEATED, F.lit(False)))
    return ordered.mapInArrow(
        _repair, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
