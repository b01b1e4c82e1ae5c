"""The cheapest repair of conversations against every possible one, and against string comparison."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from ledgerloom.llm import common, repair
from ledgerloom.llm.queries import QUERIES
from tests.conftest import SF

LAST = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def faults(turns):
    seen, out = set(), []
    for turn in turns:
        out.append("blank" if not SOLID.search(turn[1]) else "duplicate" if turn in seen else None if LAST.search(turn[1]) else "truncated")
        seen.add(turn)
    return out


def digest(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def all_repairs(turns):
    """Every choice of edits with at most two insertions in a row, kept if the roles fit."""
    marks, best = faults(turns), None
    inserts = [[("I", r, "") for r in c] for n in range(3) for c in itertools.product(("user", "assistant"), repeat=n)]
    choices = []
    for (role, text), mark in zip(turns, marks):
        extra = 3 if mark == "truncated" else 0
        own = [("D", None, 4)]
        if mark in (None, "truncated"):
            own += [("K", (role, text), extra), ("R", ("user", text), 3 + extra), ("R", ("assistant", text), 3 + extra)]
        choices.append([(i, e) for i in inserts for e in own])
    for picks in itertools.product(*choices, inserts):
        cost, word, made = 0, "", []
        for put, edit in [*picks[:-1], (picks[-1], None)]:
            cost, word = cost + 3 * len(put), word + "I" * len(put)
            made += [(r, "") for _, r, _ in put]
            if edit:
                cost, word = cost + edit[2], word + edit[0]
                made += [edit[1]] if edit[1] else []
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in made)) and (best is None or (cost, word) < best[:2]):
            best = (cost, word, digest(made))
    return best


def from_the_end(turns):
    """The least (cost, word, what is written) from each place and state on, words compared as strings."""
    marks = faults(turns)
    turned = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}
    rest = {0: (0, "", ()), 3: (0, "", ())}

    def inserted(rest):
        out = dict(rest)
        for _ in range(3):
            for state in range(4):
                if turned[state] in out:
                    cost, word, made = out[turned[state]]
                    way = (cost + 3, "I" + word, ((name[turned[state]], ""), made))
                    if state not in out or way[:2] < out[state][:2]:
                        out[state] = way
        return out

    rest = inserted(rest)
    for (role, text), mark in zip(reversed(turns), reversed(marks)):
        extra = 3 if mark == "truncated" else 0
        now = {}
        for state in range(4):
            ways = [(rest[state][0] + 4, "D" + rest[state][1], rest[state][2])]
            if mark in (None, "truncated"):
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], state))
                if to is not None:
                    ways.append((rest[to][0] + extra, "K" + rest[to][1], ((role, text), rest[to][2])))
                to = turned[state]
                ways.append((rest[to][0] + 3 + extra, "R" + rest[to][1], ((name[to], text), rest[to][2])))
            now[state] = min(ways, key=lambda w: w[:2])
        rest = inserted(now)
    cost, word, made = rest[0]
    turns = []
    while made:
        turns.append(made[0])
        made = made[1]
    return cost, word, digest(turns)


def mended(turns):
    work = repair.Repair()
    for (role, text), mark in zip(turns, faults(turns)):
        work.add(role, text, mark)
    return work.result()


ROLES = ["user", "user", "assistant", "assistant", "system", "tool", " ", "", "unknown"]
TEXTS = ["Yes.", "No", " ", "Why?", "", "a. \t", "b", "c!"]


def some_turns(random, n):
    return [(ROLES[random.integers(len(ROLES))], TEXTS[random.integers(len(TEXTS))] if random.random() < 0.6 else f"t{random.integers(10**6)}.")
            for _ in range(n)]


def test_short_conversations_against_every_repair():
    random = np.random.default_rng(1)
    for n in [0, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3, 3]:
        for _ in range(1 if n == 3 else 12):
            turns = some_turns(random, n)
            assert mended(turns) == all_repairs(turns), turns


@pytest.mark.parametrize("n", [4, 9, 63, 64, 65, 130, 700])
def test_long_conversations_against_string_order(n):
    random = np.random.default_rng(n)
    for _ in range(200 if n < 10 else 6):
        turns = some_turns(random, n)
        assert mended(turns) == from_the_end(turns), turns
    worst = [("assistant", f"{i}") for i in range(n)]
    assert mended(worst) == from_the_end(worst)


def plainly(rows):
    """The whole operator over (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[1:] for r in kept]
        marks = faults(turns)
        numbers = [r[0] for r in kept if r[0] is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, marks.count("blank"), marks.count("duplicate"),
                     marks.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), *from_the_end(turns))
    return out


def as_rows(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


def test_rows_with_every_odd_case(spark):
    common.ship(spark)
    random = np.random.default_rng(4)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(int(random.integers(1, 12))):
            role, text = some_turns(random, 1)[0]
            rows.append((conv, None if random.random() < 0.1 else int(turn * random.integers(1, 3)),
                         None if random.random() < 0.05 else role, None if random.random() < 0.05 else text))
    rows += rows[::9] + [(77, i, "user", "long " * 5000 + ".") for i in range(3)] + [(78, 5, "user", "again.")] * 40
    rows += [(79, i, r, f"turn {i}.") for i in range(300) for r in ("user", "assistant")]
    dropped = next(i for i in range(1000, 9999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone"))
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, fault string, lost int")
    got = repair.repaired(repair.damaged(table.repartition(5)))
    assert as_rows(got) == plainly(rows)
    assert as_rows(got)[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert repair.repaired(repair.damaged(none)).count() == 0


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(QUERIES["op13_conversation_repair"](spark, SF)) == plainly(rows)
