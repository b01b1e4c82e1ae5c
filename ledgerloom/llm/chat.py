"""Chat formatting: any record layout into canonical turns, turns into one template, and back.

A layout is recognised by its fingerprint, a hash of its nested field paths
(array steps as ``[]``); a declarative mapping says where turns, roles and texts
are. Tables are recognised by their schema, JSON records one by one. A turn is
written as ``### role:``, the text and ``</turn>``; inside roles and texts every
backslash and control string gets a backslash before it, which reading undoes.
The loss mask covers the texts of assistant turns.

Pieces are rows, a turn each; a conversation is its pieces in order, read as a
stream, so one of any length is never held whole. Defined cases: null texts and
roles are empty; a null conversation id is a conversation of its own; rows that
agree in id and turn follow in order of role and text; a record of an unknown
layout, or that is no JSON object, gives one row with a null turn list
(``unknown_records``); other columns of a table are ignored when the mapped ones
are there.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "conv_id string, turn long, role string, text string"


# --------------------------------------------------------------------- layouts

@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its parts. ``turns`` is the path of the turn list (None: one
    record is one turn or has fixed ``parts`` of (role, path)); ``optional`` paths may lack."""

    name: str
    conv: str | None = None
    order: str | None = None
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    parts: tuple = ()
    optional: tuple = ()
    roles: dict = field(default_factory=dict, hash=False)

    def paths(self) -> set[str]:
        inside = [f"{self.turns}[].{p}" for p in (self.role, self.text)] if self.turns else [self.role, self.text]
        return {p for p in [self.conv, self.order, *inside, *(p for _, p in self.parts)] if p}


_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
LAYOUTS = [
    Layout("rows", conv="conv_id", order="turn", role="role", text="text", roles=_NAMES),
    Layout("messages", conv="id", turns="messages", role="role", text="content", optional=("id",), roles=_NAMES),
    Layout("from_value", conv="id", turns="conversations", role="from", text="value", parts=(("system", "system"),),
           optional=("id", "system"), roles=_NAMES),
    Layout("instruction", conv="id", parts=(("system", "system"), ("user", "instruction"), ("user+", "input"),
                                           ("assistant", "output")), optional=("id", "system", "input")),
    Layout("prompt", conv="id", parts=(("system", "system"), ("user", "prompt"), ("assistant", "completion")),
           optional=("id", "system")),
    Layout("nested_prompt", conv="meta.id", turns="dialog.turns", role="speaker.role", text="body.text",
           optional=("meta.id",), roles=_NAMES),
]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _known() -> dict[str, Layout]:
    out = {}
    for layout in LAYOUTS:
        every = layout.paths()
        for k in range(len(layout.optional) + 1):
            for gone in combinations(layout.optional, k):
                out[fingerprint(every - set(gone))] = layout
    return out


def json_paths(value, at: str = "") -> set[str]:
    """The leaf paths of a JSON value."""
    if isinstance(value, dict):
        return set().union(*(json_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(json_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def _get(value, path: str | None):
    for step in path.split(".") if path else []:
        value = value.get(step) if isinstance(value, dict) else None
    return value if path else None


def _as_text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """The canonical (role, text) turns of a JSON record."""
    out: list[tuple[str, str]] = []
    for role, path in layout.parts:
        value = _get(record, path)
        if value in (None, "") and role in ("system", "user+"):
            continue
        if role.endswith("+"):  # goes on with the turn before
            out[-1] = (out[-1][0], out[-1][1] + "\n" + _as_text(value))
        else:
            out.append((role, _as_text(value)))
    if not layout.parts or layout.turns:
        for turn in (_get(record, layout.turns) or []) if layout.turns else [record]:
            role = _as_text(_get(turn, layout.role))
            out.append((layout.roles.get(role.lower(), role), _as_text(_get(turn, layout.text))))
    return out


def layout_of(record: dict, known: dict[str, Layout]) -> Layout | None:
    """The layout whose mapped paths the record has; further fields do not count, an empty turn list has all paths of a turn.

    Of several the one with most mapped paths in the record is taken, then the first of ``LAYOUTS``.
    """
    every = json_paths(record)
    if (exact := known.get(fingerprint(every))) is not None:
        return exact
    fit = []
    for layout in LAYOUTS:
        inside = {f"{layout.turns}[].{p}" for p in (layout.role, layout.text)} if layout.turns and _get(record, layout.turns) == [] else set()
        mine = layout.paths() & (every | inside)
        if mine and known.get(fingerprint(mine)) == layout:
            fit.append((len(mine), layout))
    return max(fit, key=lambda x: x[0])[1] if fit else None


def canonical_from_json(records: DataFrame, record: str = "record", id_column: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text) of JSON records of mixed layouts; unknown ones give a row with a null turn.

    A record with an empty turn list gives no row: a conversation of no turns.
    """
    known = _known()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    value = json.loads(text) if text else None
                except ValueError:
                    value = None
                layout = layout_of(value, known) if isinstance(value, dict) else None
                if layout is None:
                    rows.append((name, None, None, text))
                    continue
                conv = name if name is not None else _get(value, layout.conv)
                first = _get(value, layout.order)  # where a record is one turn of a conversation
                first = first if isinstance(first, int) else 0
                rows += [(None if conv is None else str(conv), first + i, r, t) for i, (r, t) in enumerate(turns_of(value, layout))]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()))],
                ["conv_id", "turn", "role", "text"])

    name = F.col(id_column).cast("string") if id_column else F.lit(None).cast("string")
    return records.select(name.alias("conv_id"), F.col(record).alias("record")).mapInArrow(run, SCHEMA)


def unknown_records(turns: DataFrame) -> DataFrame:
    return turns.where("turn IS NULL AND role IS NULL")


def canonical_from_rows(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table with a row per turn, recognised by the fingerprint of its columns."""
    every = schema_paths(table.schema)
    flat = [x for x in LAYOUTS if x.turns is None and not x.parts]
    layout = _known().get(fingerprint(every))
    if layout not in flat:  # further columns beside a known layout
        layout = next((x for x in flat if fingerprint(x.paths() & every) == fingerprint(x.paths())), None)
    if layout is None:
        raise ValueError(f"no layout for the columns {sorted(every)}")
    role = F.coalesce(F.col(layout.role), F.lit(""))
    renamed = F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair])
    return table.select(F.col(layout.conv).alias("conv_id"), F.col(layout.order).cast("long").alias("turn"),
                        F.coalesce(renamed[F.lower(role)], role).alias("role"),
                        F.coalesce(F.col(layout.text), F.lit("")).alias("text"))


# -------------------------------------------------------------------- template

HEAD, MIDDLE, TAIL = "### ", ":\n", "</turn>\n"
_CONTROL = r"(\\|###|</turn>|:\n)"
_TURN = re.compile(r"### ((?:\\(?:\\|###|</turn>|:\n)|[^\\])*?):\n((?:\\(?:\\|###|</turn>|:\n)|[^\\])*?)</turn>\n", re.S)
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:\n)")


def _escape(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL, r"\\$1")


def pieces(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, piece, loss_start, loss_end): each turn in the template.

    The loss span counts code points within the piece; it is empty unless the
    assistant speaks.
    """
    role, text = _escape(F.col("role")), _escape(F.col("text"))
    start = F.length(role) + len(HEAD) + len(MIDDLE)
    return turns.select(
        "conv_id", "turn", "role", "text", F.concat(F.lit(HEAD), role, F.lit(MIDDLE), text, F.lit(TAIL)).alias("piece"),
        start.alias("loss_start"), F.when(F.col("role") == "assistant", start + F.length(text)).otherwise(start).alias("loss_end"))


def read_piece(piece: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text."""
    out, at = [], 0
    while at < len(piece):
        m = _TURN.match(piece, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        out.append((_UNESCAPE.sub(r"\1", m[1]), _UNESCAPE.sub(r"\1", m[2])))
        at = m.end()
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, state, done = None, None, []

    def close():
        done.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
        done.clear()
        return out

    for batch in batches:
        for conv, piece, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if now != (conv,):
                if now is not None:
                    close()
                now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_piece(piece):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            masked = _UNESCAPE.sub(r"\1", piece[a:b])
            state[2] += len(masked)
            state[3].update(masked.encode("utf-8", "surrogatepass"))
            state[4] += len(piece)
        if done:
            yield rows()
    if now is not None:
        close()
        yield rows()


def digests(formatted: DataFrame) -> DataFrame:
    """What each conversation's formatted text says when read back, and its length.

    Pieces come sorted and are read one after another; a digest runs through a
    conversation in order, so one conversation is one task's stream, never its memory.
    """
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "piece", "loss_start", "loss_end").mapInArrow(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
