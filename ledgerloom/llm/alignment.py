"""Alignment of two tokenizers over the same texts, and how often their tokens meet.

A text is tokenised by both (A with a space put before it, which B puts there
itself). Both spell the same bytes, so marks on the bytes where their tokens end
say all: an end of both closes a group, and between two ends of either one token
of each side goes on, which is a link.

Two tokens are linked where their bytes overlap; an id pair counts its links over
all texts. Counts are summed in each task before the shuffle. The most frequent
pairs, at most ``SENT_PAIRS`` of them at 13 bytes each, travel to the tasks; what
a text holds of all others is looked up by a join, so nothing sent grows with the
input. The highest count of a B id is one row per entry of B's vocabulary.

Between single spaces that provably separate the ids of both tokenizers (checked
on their files) a stretch of text is tokenised once per task and remembered;
without that property texts are tokenised as they stand.

Defined cases: null and empty texts, and texts whose tokens do not spell a space
and the text on both sides, have no tokens, zeros and an empty ``groups``; a
repeated row counts again; a special token's string is plain text; an empty table
gives no rows. Only doc_id and text are looked at.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import common as C

A_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
B_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Stretches between spaces remembered per task; links counted there before they are given out.
REMEMBERED, HELD = 400_000, 1 << 20
SENT_PAIRS = 1 << 20
#: Texts tokenised at once, in bytes, or one longer text.
STRETCH = 1 << 19
#: Stretches between spaces tokenised as one text.
TOGETHER = 2000
MARK = "\u2581"
_SINGLE_SPACE = re.compile("(?<=[!-~]) (?=[!-~])")


# ------------------------------------------------------------------ tokenizers

def byte_letters() -> dict[str, int]:
    """The byte behind each letter that byte-level vocabularies are written in."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of texts and the bytes of an id.

    ``local``: its ids before and after a single space between printable ASCII
    characters do not depend on each other.
    """

    def __init__(self, entries: list[bytes], ids: Callable[[list[str]], list[list[int]]], local: bool):
        self.entries, self.ids, self.local = entries, ids, local
        self.size = np.array([len(e) for e in entries], np.int64)

    def spells(self, ids: Iterable[int], text: bytes) -> bool:
        return b"".join(map(self.entries.__getitem__, ids)) == text


def byte_level(model: str) -> Side:
    """Side A, from the text of its vocabulary file; a space goes before every text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallel work
    from tokenizers import Tokenizer

    coder = Tokenizer.from_str(model)
    coder.encode_special_tokens = True
    letters = byte_letters()

    def entry(i: int) -> bytes:
        token = coder.id_to_token(i) or ""
        return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    # its pattern ends every piece before such a space, and looks only ahead
    parts = json.loads(model)
    cutter = parts.get("pre_tokenizer") or {}
    local = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not parts.get("normalizer") and not parts.get("post_processor")
    return Side([entry(i) for i in range(coder.get_vocab_size(with_added_tokens=True))],
                lambda texts: [e.ids for e in coder.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], local)


def pieces(model: bytes) -> Side:
    """Side B, from the bytes of its model file; it puts the space before a text itself."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [coder.id_to_piece(i) for i in range(coder.vocab_size())]

    def entry(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(MARK, " ").encode()

    # no piece goes on after a space, so none crosses one
    local = not any(MARK in name.lstrip(MARK) for name in names)
    return Side([entry(name) for name in names], lambda texts: coder.encode(texts, num_threads=1), local)


# ------------------------------------------------------------------- alignment

def _before(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and how often each occurs."""
    ordered = np.sort(values)
    first = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] - 1))
    return ordered[first], np.diff(first, append=len(ordered))


#: What parts of a text say: of each (ids on side A, ids on side B, groups, links), the links of all, and the groups of each
#: (with a ";" behind each group).
Said = tuple[np.ndarray, np.ndarray, list[str]]
_NOTHING = np.zeros((1, 4), np.int64), np.zeros(0, np.int64), [""]


class Texts:
    """(ids on side A, ids on side B, groups, links, groups as text) of whole texts; what lies between single spaces is worked out
    once and remembered, until ``REMEMBERED`` stretches are known."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b, self.local = a, b, a.local and b.local
        # an id is written with what follows it: within a group a comma, at its end the other side or the next group
        self.written = [f"{i}{end}" for side, ends in ((a, ",|"), (b, ",;")) for i in range(len(side.size)) for end in ends]
        self._forget()

    def _forget(self) -> None:
        # the place of each stretch among the figures and groups
        self.number: dict[str, int] = {}
        self.figures, self.links, self.groups = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), []

    def _read(self, a: list[int], b: list[int], starts: np.ndarray) -> Said:
        """Both sides spell the same bytes; parts begin and end at ``starts``, where tokens of both sides end."""
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.a.size[ids_a]), np.cumsum(self.b.size[ids_b])
        is_a, is_b = np.zeros(starts[-1] + 1, bool), np.zeros(starts[-1] + 1, bool)
        is_a[end_a], is_b[end_b] = True, True
        # how many tokens of each side, groups and links have ended up to each byte
        done_a, done_b, done, linked = (np.cumsum(x) for x in (is_a, is_b, is_a & is_b, is_a | is_b))
        figures = np.diff([x[starts] for x in (done_a, done_b, done, linked)]).T
        # between two ends of either side, one token of each side goes on
        before = np.flatnonzero(is_a | is_b) - 1
        links = ids_a[done_a[before]] << 16 | ids_b[done_b[before]]
        codes = np.concatenate((2 * ids_a + is_b[end_a], 2 * (len(self.a.size) + ids_b) + is_a[end_b]))
        order = np.argsort(np.concatenate((2 * done[end_a - 1], 2 * done[end_b - 1] + 1)), kind="stable")
        words = list(map(self.written.__getitem__, codes[order].tolist()))
        ends = np.cumsum(figures[:, 0] + figures[:, 1]).tolist()
        return figures, links, ["".join(words[i:j]) for i, j in zip([0, *ends], ends)]

    def _one(self, text: str, a: list[int], b: list[int]) -> Said:
        """What a text says as it stands: nothing if one side does not spell it."""
        spelt = (" " + text).encode()
        if self.a.spells(a, spelt) and self.b.spells(b, spelt):
            return self._read(a, b, np.array([0, len(spelt)]))
        return _NOTHING

    def _together(self, parts: list[str]) -> Iterator[Said]:
        """The same of texts that single spaces may join: tokens of both sides end before every one."""
        joined = " ".join(parts)
        spelt = (" " + joined).encode()
        (a,), (b,) = self.a.ids([joined]), self.b.ids([joined])
        if self.a.spells(a, spelt) and self.b.spells(b, spelt):
            sizes = list(map(len, parts)) if len(spelt) == len(joined) + 1 else [len(p.encode()) for p in parts]
            starts = np.zeros(len(parts) + 1, np.int64)
            np.cumsum(np.array(sizes) + 1, out=starts[1:])
            yield self._read(a, b, starts)
        elif len(parts) == 1:
            yield _NOTHING
        else:
            yield from self._together(parts[: len(parts) // 2])
            yield from self._together(parts[len(parts) // 2:])

    def _learn(self, fresh: list[str]) -> None:
        plain = [s for s in fresh if self.local and "!" <= s[0] <= "~" and "!" <= s[-1] <= "~"]
        said = [x for first in range(0, len(plain), TOGETHER) for x in self._together(plain[first: first + TOGETHER])]
        known = set(plain)
        rest = [s for s in fresh if s not in known]
        said += [self._one(s, x, y) for s, x, y in zip(rest, self.a.ids(rest), self.b.ids(rest))]
        self.number.update(zip(plain + rest, range(len(self.number), len(self.number) + len(fresh))))
        self.figures = np.concatenate([self.figures, *(s[0] for s in said)])
        self.links = np.concatenate([self.links, *(s[1] for s in said)])
        self.groups.extend(chain.from_iterable([s[2] for s in said]))

    def of(self, texts: list[str]) -> Iterator[tuple[int, int, int, bytes, str]]:
        """Of each text; zeros, no links and no groups if its ids do not spell a space and the text on both sides."""
        cut = [(_SINGLE_SPACE.split(t) if self.local else [t]) if t else [] for t in texts]
        here = set(chain.from_iterable(cut))
        fresh = here.difference(self.number)
        if len(self.number) + len(fresh) > REMEMBERED:
            self._forget()
            fresh = here
        if fresh:
            self._learn(list(fresh))
        n_links = self.figures[:, 3]
        first = _before(n_links)
        for text, parts in zip(texts, cut):
            places = list(map(self.number.__getitem__, parts))
            at = np.array(places, np.int64)
            n = n_links[at]  # a stretch that is spelt has links
            if n.all():
                place = np.repeat(first[at] - _before(n), n) + np.arange(n.sum())
                links, groups = self.links[place], "".join(map(self.groups.__getitem__, places))
                n_a, n_b, n_groups, _ = self.figures[at].sum(axis=0).tolist()
            else:
                ((n_a, n_b, n_groups, _),), links, (groups,) = self._one(text, self.a.ids([text])[0], self.b.ids([text])[0])
                n_a, n_b, n_groups = int(n_a), int(n_b), int(n_groups)
            yield n_a, n_b, n_groups, links.tobytes(), groups[:-1]


_NAMES = ["pair", "c", "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
_SCHEMA = ("pair long, c long, row long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups string,"
           " pairs array<long>, times array<long>")


def aligned(documents: DataFrame, a_vocabulary: str = A_VOCABULARY, b_vocabulary: str = B_VOCABULARY) -> DataFrame:
    """Two kinds of rows. With ``row``: a text's figures, its ``groups`` (``a1,a2|b1;a3|b2,b3``) and its distinct links with
    how often each occurs (a pair is the A id times 65536 and the B id). With ``pair``: how often links occur in a stretch of a task."""
    with open(a_vocabulary, encoding="utf-8") as first, open(b_vocabulary, "rb") as second:
        models = documents.sparkSession.sparkContext.broadcast((first.read(), second.read()))
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T._parse_datatype_string(_SCHEMA.format(rows.schema["doc_id"].dataType.simpleString()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(models.value[0]), pieces(models.value[1])
        both = Texts(a, b)
        row = TaskContext.get().partitionId() << 40
        gc.disable()  # what is remembered has no cycles, and walking through it again and again costs a quarter of the time
        try:
            for batch in batches:
                kind, held, size = batch.column("doc_id").type, [], 0
                for first, texts in _stretches(batch.column("text")):
                    done = []
                    for n_a, n_b, n_groups, links, groups in both.of(texts):
                        pair, times = _counted(np.frombuffer(links, np.int64))
                        held.append((pair, times))
                        size += len(pair)
                        done.append((row, n_a, n_b, n_groups, len(links) >> 3, groups, pair, times))
                        row += 1
                    yield _text_rows(batch.column("doc_id").slice(first, len(texts)), done)
                    if size > HELD:
                        yield _count_rows(held, kind)
                        held, size = [], 0
                if size:
                    yield _count_rows(held, kind)
        finally:
            gc.enable()

    return rows.mapInArrow(run, schema)


def _stretches(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch (null: empty) in stretches of about ``STRETCH`` characters, or one longer text."""
    held, first, size = [], 0, 0
    for i, value in enumerate(column):
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size > STRETCH:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))


def _text_rows(doc_ids: pa.Array, done: list[tuple]) -> pa.RecordBatch:
    row, n_a, n_b, n_groups, n_links, groups, pairs, times = zip(*done)
    n = len(done)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(row, pa.int64()), doc_ids,
         *(pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups, n_links)), pa.array(groups, pa.string()), _lists(pairs), _lists(times)], _NAMES)


def _count_rows(held: list[tuple], doc_id: pa.DataType) -> pa.RecordBatch:
    pair, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    n, c = len(pair), np.bincount(at, np.concatenate([t for _, t in held])).astype(np.int64)
    none = [pa.nulls(n, k) for k in (pa.int64(), doc_id, *[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(c), *none], _NAMES)


# ---------------------------------------------------------------------- counts

def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, c, best): how often each pair is linked in all texts, and whether no pair of its B id is more often."""
    sums = rows.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("c").alias("c"))
    b = (F.col("pair") % 65536).alias("b")
    most = sums.groupBy(b).agg(F.max("c").alias("most"))  # at most one row per entry of the vocabulary
    return sums.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "c", (F.col("c") == F.col("most")).alias("best"))


def _looked_up(sent):
    """Per text what the sent pairs say (``row``), and the pairs that were not sent (``pair``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, c, best = sent.value
        for batch in batches:
            rows, lists, times = (batch.column(n) for n in ("row", "pairs", "times"))
            sizes = np.diff(lists.offsets.to_numpy())
            wanted, often = lists.flatten().to_numpy(), times.flatten().to_numpy()
            text = np.repeat(np.arange(len(rows)), sizes)
            at = np.minimum(np.searchsorted(pair, wanted), max(0, len(pair) - 1))
            hit = pair[at] == wanted if len(pair) else np.zeros(len(wanted), bool)
            total, tops = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            if hit.any():
                np.add.at(total, text[hit], often[hit] * c[at[hit]])
                np.add.at(tops, text[hit], often[hit] * best[at[hit]])
            n, m = len(rows), int((~hit).sum())
            rows = rows.to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((rows, rows[text[~hit]]))), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(wanted[~hit])]),
                 pa.array(np.concatenate((np.zeros(n, np.int64), often[~hit]))), pa.array(np.concatenate((tops, np.zeros(m, np.int64)))),
                 pa.array(np.concatenate((total, np.zeros(m, np.int64))))], ["row", "pair", "times", "n_best", "count_sum"])

    return run


def scored(rows: DataFrame, space: C.Workspace) -> DataFrame:
    """The text rows of a stored ``aligned`` table with n_best and count_sum, without their links."""
    spark = rows.sparkSession
    counts = space.keep(pair_counts(rows), "counts")
    # by doublings of the count: at most 64 rows
    steps = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("s")).agg(F.count("*").alias("n")).collect()
    cut, most = 64, 0
    for r in sorted(steps, key=lambda r: -r.s):
        if most + r.n > SENT_PAIRS:
            break
        cut, most = r.s, most + r.n
    frequent = counts.where(F.col("c") >= 2**cut if cut < 62 else F.lit(False)).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast(
        (frequent["pair"].to_numpy(), frequent["c"].to_numpy(), frequent["best"].to_numpy().astype(np.int64)))
    texts = rows.where("row IS NOT NULL")
    looked = texts.select("row", "pairs", "times").mapInArrow(
        _looked_up(sent), "row long, pair long, times long, n_best long, count_sum long")
    rare = F.col("best") & F.col("pair").isNotNull()
    sums = looked.join(counts, "pair", "left").groupBy("row").agg(
        F.sum(F.col("n_best") + F.when(rare, F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("count_sum") + F.col("times") * F.coalesce("c", F.lit(0))).alias("count_sum"))
    return texts.drop("pair", "c", "pairs", "times").join(sums, "row").drop("row")
