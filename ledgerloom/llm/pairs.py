"""Byte-level byte-pair encoding and decoding, as relational work in DuckDB inside each partition.

Texts are cut into pieces by the published pattern, with array operations over
character classes. The distinct pieces of a stretch of texts that are not known
yet become rows (word, position, token); a recursive query joins neighbouring
tokens with the merge table (every split of a vocabulary entry into two entries)
and contracts each word's leftmost pair of least rank until no pair is left.
Ordered aggregation lists the ids of a text, and decodes ids to bytes.

Words over ``LONG`` bytes go through a second recursive query that contracts, in
one step, all pairs of the least rank up to the first one beside which something
of a lower rank would come up; that gives the same ids in far fewer steps and
keeps one row per position.

Bounds: a stretch is ``STRETCH`` bytes or one longer text; at most ``KNOWN``
encoded pieces are kept per worker; a round of the recursion takes words whose
squared lengths add up to ``ROUND``. The vocabulary (under 1 MB) and the table of
character classes (1.1 MB) travel to the tasks, whatever the size of the input.

Character classes are those of the library that the ids have to equal: where two
Unicode versions at hand disagree on a character, the driver asks it.

Defined cases: null and empty texts have no ids; null ids decode to no bytes; an
id outside the vocabulary is an error; repeated rows are repeated; only the two
columns named are looked at.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import common as C
from ledgerloom.llm.tokens import PATTERN, VOCABULARY, read_ranks

STRETCH, KNOWN, ROUND, LONG = 1 << 21, 300_000, 1 << 20, 64
LETTER, NUMBER, OTHER, SPACE = range(4)
#: Contractions that are pieces of their own where a piece begins with the apostrophe.
_ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


# -------------------------------------------------------------------- pieces

def _by_asking(characters: str) -> list[int]:
    """The classes the encoding library gives to characters, told from where it cuts."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    for first in b"a1!":
        for b in range(128, 256):
            ranks[bytes([first, b])] = len(ranks)
    coder = tiktoken.Encoding("classes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def joins(first: str, c: str) -> bool:
        return len(coder.encode_ordinary(first + c)) == len(c.encode())

    return [next((kind for kind, first in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if joins(first, c)), SPACE)
            for c in characters]


def character_classes() -> bytes:
    """One class per code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    named = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        named[[ord(c) for c in regex.findall(pattern, every)]] = kind
    by_letter = {"L": LETTER, "N": NUMBER}
    other = np.array([by_letter.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
    other[named == SPACE] = SPACE
    doubtful = np.flatnonzero(named != other)
    named[doubtful] = _by_asking("".join(map(chr, doubtful)))
    return named.tobytes()


def cut(data: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts in ``data`` begin, in bytes; texts begin at ``starts`` (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64)
    place = np.flatnonzero((data & 0xC0) != 0x80)  # of each character
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n, kind = len(code), classes[code]
    opens = np.zeros(n + 1, bool)
    opens[np.searchsorted(place, starts)] = True
    opens[n] = True
    run = opens.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    begins = run.copy()
    # white space before something else gives its last character away; a plain space joins what follows
    after = np.flatnonzero(run[:n] & ~opens[:n] & (kind != SPACE))
    after = after[kind[after - 1] == SPACE]
    begins[after - 1] = True
    begins[after[code[after - 1] == 32]] = False
    quotes = np.flatnonzero((code == 39) & begins[:n])
    for ending in _ENDINGS:
        size = len(ending)
        at = quotes[quotes + size < n]
        for i, c in enumerate(ending, 1):
            at = at[(code[at + i] == ord(c)) & ~opens[at + i]]
        begins[at + 1] = False
        begins[at + 1 + size] = True
    return place[np.flatnonzero(begins[:n])]


# ------------------------------------------------------------------- encoding

_SHORT = """
WITH RECURSIVE t(step, word, pos, id, next_pos, next_id) AS (
  SELECT 0, word, pos, id, lead(pos) OVER w, lead(id) OVER w FROM parts WINDOW w AS (PARTITION BY word ORDER BY pos)
  UNION ALL (
    WITH least AS (
      SELECT word, min(m.id::BIGINT << 32 | pos) AS place, arg_min(next_pos, m.id::BIGINT << 32 | pos) AS gone
      FROM t JOIN merges m ON t.next_id = m.r AND t.id = m.l GROUP BY word),
    change AS (
      SELECT l.word, (place & 4294967295)::INT AS spot, (place >> 32)::INT AS pair, gone, t.next_pos AS then_pos, t.next_id AS then_id
      FROM least l JOIN t ON t.word = l.word AND t.pos = l.gone)
    SELECT step + 1, word, pos, CASE WHEN pos = spot THEN pair ELSE id END, CASE WHEN pos = spot THEN then_pos ELSE next_pos END,
      CASE WHEN pos = spot THEN then_id WHEN next_pos = spot THEN pair ELSE next_id END
    FROM t JOIN change USING (word) WHERE pos <> gone))
SELECT word, list(id ORDER BY pos) AS ids FROM t
JOIN (SELECT word, max(step) AS step FROM t GROUP BY word) USING (word, step) GROUP BY word"""

# The rows of a contraction: the left token changes, the right one goes (a null id). Pairs of one rank
# that overlap are taken from the left, every other one. What a contraction would put beside its left
# neighbour is asked after that neighbour's own contraction, as it comes first.
_LONG = """
WITH RECURSIVE t(word, pos, id) USING KEY (word, pos) AS (
  SELECT word, pos, id FROM parts
  UNION (
    WITH near AS (
      SELECT word, pos, id, lead(id) OVER w AS next_id, lead(pos) OVER w AS next_pos, row_number() OVER w AS n
      FROM recurring.t WHERE id IS NOT NULL WINDOW w AS (PARTITION BY word ORDER BY pos)),
    ranked AS (SELECT near.*, m.id AS pair FROM near LEFT JOIN merges m ON near.id = m.l AND near.next_id = m.r),
    least AS (SELECT *, pair IS NOT NULL AND pair = min(pair) OVER (PARTITION BY word) AS hit FROM ranked),
    runs AS (SELECT *, n - sum(hit::INT) OVER (PARTITION BY word ORDER BY pos) AS run FROM least),
    turns AS (SELECT *, hit AND row_number() OVER (PARTITION BY word, run, hit ORDER BY pos) % 2 = 1 AS taken FROM runs),
    sides AS (
      SELECT *, CASE WHEN lag(taken, 2) OVER w THEN lag(pair, 2) OVER w ELSE lag(id) OVER w END AS before, lead(id, 2) OVER w AS behind
      FROM turns WINDOW w AS (PARTITION BY word ORDER BY pos)),
    doubt AS (
      SELECT s.word, min(s.pos) AS stop FROM sides s
      LEFT JOIN merges a ON a.l = s.before AND a.r = s.pair LEFT JOIN merges b ON b.l = s.pair AND b.r = s.behind
      WHERE s.taken AND (a.id < s.pair OR b.id < s.pair) GROUP BY s.word),
    done AS (SELECT s.* FROM sides s LEFT JOIN doubt d USING (word) WHERE s.taken AND (d.stop IS NULL OR s.pos <= d.stop))
    SELECT word, pos, pair FROM done UNION ALL SELECT word, next_pos, NULL FROM done))
SELECT word, list(id ORDER BY pos) AS ids FROM t WHERE id IS NOT NULL GROUP BY word"""


class Coder:
    """A vocabulary as tables of a DuckDB database in this worker's memory."""

    def __init__(self, ranks: bytes):
        import duckdb

        entries = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        self.byte = np.array([entries[bytes([b])] for b in range(256)], np.int32)
        splits = [(entries.get(e[:i]), entries.get(e[i:]), r) for e, r in entries.items() for i in range(1, len(e))]
        splits = np.array([s for s in splits if None not in s], np.int32).reshape(-1, 3)
        self._table("merges", "SELECT * FROM given", l=splits[:, 0], r=splits[:, 1], id=splits[:, 2])
        self._table("entries", "SELECT *, hex(piece) AS digits FROM given",
                    piece=pa.array(list(entries), pa.binary()), id=np.array(list(entries.values()), np.int32))
        self.db.execute("CREATE TABLE known (piece BLOB, ids INT[])")

    def _table(self, name: str, select: str, **columns) -> None:
        given = pa.table({k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in columns.items()})
        self.db.register("given", given)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS {select}")
        self.db.unregister("given")

    def _learn(self, pieces: pa.Array) -> None:
        """Encode pieces that are no vocabulary entry and add them to the known ones."""
        _, offsets, data = pieces.buffers()
        ends = np.frombuffer(offsets, np.int32)[pieces.offset: pieces.offset + len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)
        size = np.diff(ends)
        order = np.argsort(size, kind="stable")
        room = np.cumsum(np.where(size[order] > LONG, size[order] * 8, size[order] ** 2))
        # words of one round are of like length: a round ends where the length doubles or the room is used up
        group = np.stack([np.ceil(np.log2(np.maximum(size[order], 2))), size[order] > LONG, room // ROUND])
        for part in np.split(order, np.flatnonzero((np.diff(group) != 0).any(0)) + 1):
            word = np.repeat(part, size[part])
            pos = np.arange(len(word)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            ids = self.byte[data[ends[word] + pos]]
            self._table("parts", "SELECT * FROM given", word=word.astype(np.int32), pos=pos.astype(np.int32), id=ids)
            self.db.register("fresh", pa.table({"word": pa.array(part.astype(np.int32)), "piece": pieces.take(pa.array(part))}))
            query = _LONG if size[part[0]] > LONG else _SHORT
            self.db.execute(f"INSERT INTO known SELECT piece, ids FROM ({query}) JOIN fresh USING (word)")
            self.db.unregister("fresh")

    def encode(self, data: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> pa.Array:
        """The ids of each text, as lists."""
        at = cut(data, starts, classes)
        n = len(starts) - 1
        if not len(at):
            return pa.array([[]] * n, pa.list_(pa.int32()))
        edges = np.append(at, len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(data.tobytes())])
        coded = pieces.dictionary_encode()
        self.db.register("words", pa.table({"w": pa.array(np.arange(len(coded.dictionary), dtype=np.int32)), "piece": coded.dictionary}))
        if self.db.execute("SELECT count(*) FROM known").fetchall()[0][0] > KNOWN:
            self.db.execute("CREATE OR REPLACE TABLE known (piece BLOB, ids INT[])")
        fresh = self.db.sql("SELECT piece FROM words ANTI JOIN known USING (piece)").to_arrow_table()["piece"]
        if len(fresh):
            self.db.register("fresh", pa.table({"piece": fresh}))
            self.db.execute("INSERT INTO known SELECT piece, [id] FROM fresh JOIN entries USING (piece)")
            rest = self.db.sql("SELECT piece FROM fresh ANTI JOIN entries USING (piece)").to_arrow_table()["piece"]
            self.db.unregister("fresh")
            if len(rest):
                self._learn(pa.concat_arrays(rest.cast(pa.binary()).chunks))
        self.db.register("places", pa.table({
            "doc": pa.array((np.searchsorted(starts[1:], at, "right")).astype(np.int32)), "place": pa.array(np.arange(len(at))), "w": coded.indices}))
        got = self.db.sql(
            "SELECT doc, flatten(list(ids ORDER BY place)) AS ids FROM places"
            " JOIN (SELECT w, ids FROM words JOIN known USING (piece)) USING (w) GROUP BY doc ORDER BY doc").to_arrow_table()
        self.db.unregister("places")
        self.db.unregister("words")
        return _in_rows(got["doc"].to_numpy(), got["ids"], n, pa.list_(pa.int32()))

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes that lists of ids stand for."""
        self.db.register("given", pa.table({"doc": pa.array(np.arange(len(ids), dtype=np.int32)), "ids": ids}))
        got = self.db.sql(
            "WITH one AS (SELECT doc, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM given)"
            " SELECT doc, unhex(string_agg(coalesce(digits, error('no such id')), '' ORDER BY pos)) AS text"
            " FROM one LEFT JOIN entries USING (id) GROUP BY doc ORDER BY doc").to_arrow_table()
        self.db.unregister("given")
        return _in_rows(got["doc"].to_numpy(), got["text"], len(ids), pa.binary())


def _in_rows(rows: np.ndarray, values: pa.ChunkedArray, n: int, kind: pa.DataType) -> pa.Array:
    """The values in their rows; rows without one are empty."""
    at = np.full(n, len(rows))
    at[rows] = np.arange(len(rows))
    empty = pa.array([[] if pa.types.is_list(kind) else b""], kind)
    return pa.concat_arrays([*(c.cast(kind) for c in values.chunks), empty]).take(pa.array(at))


_CODERS: dict[int, Coder] = {}


def _coder(ranks: bytes) -> Coder:
    """One database per worker and vocabulary."""
    key = hash(ranks)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(ranks)
    return _CODERS[key]


# ------------------------------------------------------------------ operators

def encode(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row's whole text."""
    context = documents.sparkSession.sparkContext
    shared = context.broadcast((read_ranks(vocabulary), character_classes()))
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, classes = _coder(shared.value[0]), np.frombuffer(shared.value[1], np.uint8)
        for batch in batches:
            for texts in C.text_chunks(batch.column("text"), STRETCH):
                ids = coder.encode(texts.data, texts.starts, classes)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(texts.rows[0], len(texts)), ids], ["doc_id", "ids"])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of ``encoded`` and ``text``: the bytes that ``ids`` stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    rows = encoded.drop("text")
    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            ids = batch.column("ids")
            size = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy()))
            first = 0
            while first < len(ids):  # a quarter as many ids as bytes in a stretch, or one longer text
                last = max(first + 1, int(np.searchsorted(size, size[first] + STRETCH // 4, "right")) - 1)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, coder.decode(part.column("ids"))], schema.names)
                first = last

    return rows.mapInArrow(run, schema)
