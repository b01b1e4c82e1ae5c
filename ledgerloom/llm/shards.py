"""Training order on disk: token sequences in a keyed permutation, in fixed-stride shards.

Documents become token ids, each with an end id. They follow one another in the
order of a hash of id and text, whatever the partitions and the cluster, and the
stream is cut into sequences of ``LENGTH`` ids; only the very last is padded (with
end ids). Sequences are numbered 0 .. N-1. A keyed Feistel network over the next
power of four, walked until it lands below N, sends a number to its global slot.
Slots are cut into ranges of ``PER_SHARD``; one task, its partition the shard's
number, writes a shard's slots in order, 2 * LENGTH bytes each, little-endian
16-bit. Slot s is at byte (s mod PER_SHARD) * 2 * LENGTH of shard s div PER_SHARD,
so a reader resumes at any slot by arithmetic alone, and ``source_of`` inverts the
permutation.

Only numbers are sorted: (hash, id, count) rows are summed up in ranges of the
hash, at most ``MOST_RANGES``, and each input partition gets a file with the place
of each of its documents in the stream. The ids then travel once, from their
document to their shard. The number of ranges cuts the work, never the result.

Defined cases: null and empty texts add nothing; repeated rows are written each,
and equal ones meet in one range; a null id is listed as null; a text of any length
runs over as many sequences as it needs; an empty table writes no shard. A shard is
written beside its place and renamed, so a repeated task leaves one whole file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import Workspace, batches_of, mix
from ledgerloom.llm.tokens import VOCABULARY, Encoder, read_ranks

LENGTH = 2048
PER_SHARD = 1024
KEY = 20240601
ROUNDS = 6
#: Tokens of the documents that a range of the hash should hold, and the most ranges.
RANGE_TOKENS, MOST_RANGES = 1 << 22, 1 << 17
#: Rows of a batch between Spark and Python.
BATCH_ROWS = 1024


# ----------------------------------------------------------------- permutation

def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(x: np.ndarray, i: int, key: int, half: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x + np.uint64((key * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) % 2**64)) & np.uint64(2**half - 1)


def _network(x: np.ndarray, key: int, half: int, back: bool) -> np.ndarray:
    left, right = x >> np.uint64(half), x & np.uint64(2**half - 1)
    for i in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)):
        if back:
            left, right = right ^ _round(left, i, key, half), left
        else:
            left, right = right, left ^ _round(right, i, key, half)
    return left << np.uint64(half) | right


def _walk(x: np.ndarray, n: int, key: int, back: bool) -> np.ndarray:
    half = _half_bits(n)
    out = _network(np.asarray(x, np.uint64), key, half, back)
    while (far := out >= np.uint64(n)).any():
        out[far] = _network(out[far], key, half, back)
    return out.astype(np.int64)


def slot_of(number, n: int, key: int = KEY) -> np.ndarray:
    """The slots of sequence numbers: a permutation of 0 .. n-1."""
    return _walk(number, n, key, False)


def source_of(slot, n: int, key: int = KEY) -> np.ndarray:
    """The sequence numbers at slots."""
    return _walk(slot, n, key, True)


# --------------------------------------------------------------------- packing

def _coded(ranks):
    """Texts as the compressed bytes of their ids and the end's; ``part`` and ``k`` number the rows."""
    names = ["part", "k", "place", "doc_id", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, k = Encoder(ranks.value), TaskContext.get().partitionId(), 0
        end = np.array([coder.end], np.uint16)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                size = some.num_rows
                ids = [np.concatenate((coder.ids(text.as_py()), end)) for text in some.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, part, np.int32)), pa.array(np.arange(k, k + size)), some.column("place"), some.column("doc_id"),
                     pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in ids], pa.binary())], names)
                k += size

    return run


def _whole_file(folder: str, name: str, parts: Iterator[bytes]) -> None:
    """Write beside the place and rename: a repeated task leaves one whole file."""
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    draft = f"{root}/.draft-{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    files.move(draft, f"{root}/{name}")


def _note_places(folder: str):
    """A file for each ``part`` with the places of its rows in order of ``k``; rows come sorted by both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, [], []

        def close():
            if now is not None:
                _whole_file(folder, f"part-{now:08d}.bin", held)
                done.append(now)

        for batch in batches:
            part, at = batch.column("part").to_numpy(), batch.column("at").to_numpy()
            bounds = np.flatnonzero(np.diff(part, prepend=part[:1] - 1)).tolist() if len(part) else []
            for a, b in zip(bounds, [*bounds[1:], len(part)]):
                if part[a] != now:
                    close()
                    now, held = int(part[a]), []
                held.append(at[a:b].tobytes())
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], ["part"])

    return run


def _deal(places: str, n: int, key: int, length: int, per_shard: int):
    """Documents cut at the ends of sequences, and the pieces gathered by shard, some 64 MB at a time."""
    names = ["shard", "slots", "begins", "docs", "sizes", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (sequence, where the piece begins in it, doc id, bytes)
        weight, now, begins = 0, None, None

        def flush():
            nonlocal weight
            groups: dict[int, list] = {}
            for slot, piece in zip(slot_of([h[0] for h in held], n, key).tolist() if held else [], held):
                groups.setdefault(slot // per_shard, []).append((slot, *piece[1:]))
            for shard, rows in groups.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
                     pa.array([[r[1] for r in rows]], pa.list_(pa.int32())), pa.array([[r[2] for r in rows]], pa.list_(pa.int64())),
                     pa.array([[len(r[3]) for r in rows]], pa.list_(pa.int32())),
                     pa.array([zlib.compress(b"".join(r[3] for r in rows), 1)], pa.binary())], names)
            held.clear()
            weight = 0

        for batch in batches:
            parts, ks, docs = (batch.column(c).to_pylist() for c in ("part", "k", "doc_id"))
            for part, k, doc, ids in zip(parts, ks, docs, batch.column("ids")):
                if part != now:
                    files, root = pafs.FileSystem.from_uri(places)
                    with files.open_input_stream(f"{root}/part-{part:08d}.bin") as source:
                        now, begins = part, np.frombuffer(source.read(), np.int64)
                ids, at = memoryview(zlib.decompress(ids.as_py())), int(begins[k])
                while len(ids):
                    taken = min(len(ids) // 2, length - at % length)
                    held.append((at // length, at % length, doc, bytes(ids[: 2 * taken])))
                    ids, at, weight = ids[2 * taken:], at + taken, weight + 2 * taken
                    if weight > 64 << 20:
                        yield from flush()
        yield from flush()

    return run


def _write(folder: str, length: int, per_shard: int, end: int):
    """One shard after another: its parts put in slot order and written as one file."""
    stride, names, pad = 2 * length, ["slot", "shard", "byte_offset", "doc_ids", "n_tokens"], np.array([end], np.uint16).tobytes()

    def one(shard: int, parts: list[dict]) -> pa.RecordBatch:
        pieces = []
        for part in parts:
            block, bounds = zlib.decompress(part["blob"]), np.cumsum([0, *part["sizes"]]).tolist()
            pieces += [(slot, begin, doc, block[a:b]) for slot, begin, doc, a, b in
                       zip(part["slots"], part["begins"], part["docs"], bounds, bounds[1:])]
        rows = []  # (slot, doc ids, bytes)
        for slot, mine in groupby(sorted(pieces, key=lambda r: r[:2]), key=lambda r: r[0]):
            mine = list(mine)
            rows.append((slot, [r[2] for r in mine], b"".join(r[3] for r in mine)))
        _whole_file(folder, f"shard-{shard:08d}.bin", (x for r in rows for x in (r[2], pad * (length - len(r[2]) // 2))))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([shard] * len(rows), pa.int64()),
             pa.array([r[0] % per_shard * stride for r in rows], pa.int64()),
             pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([len(r[2]) // 2 for r in rows], pa.int32())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if shard is not None and row["shard"] != shard:
                    yield one(shard, parts)
                    parts = []
                shard = row["shard"]
                parts.append(row)
        if parts:
            yield one(shard, parts)

    return run


def materialise(documents: DataFrame, space: Workspace, vocabulary: str = VOCABULARY, key: int = KEY,
                length: int = LENGTH, per_shard: int = PER_SHARD) -> tuple[DataFrame, str]:
    """Write the shards; (slot, shard, byte_offset, doc_ids, n_tokens) per sequence, and the shards' folder."""
    with batches_of(documents.sparkSession, BATCH_ROWS):
        return _materialised(documents, space, vocabulary, key, length, per_shard)


def _materialised(documents: DataFrame, space: Workspace, vocabulary: str, key: int, length: int, per_shard: int) -> tuple[DataFrame, str]:
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    docs = documents.where("text IS NOT NULL AND text <> ''").select(
        F.xxhash64("doc_id", "text").alias("place"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = space.keep(docs.mapInArrow(_coded(ranks), "part int, k long, place long, doc_id long, n long, ids binary"), "coded")
    total = coded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = -(-total // length)
    bits = min(MOST_RANGES.bit_length() - 1, (total // RANGE_TOKENS).bit_length())
    cut = F.shiftright(F.col("place"), 64 - bits).cast("int") + 2 ** (bits - 1) if bits else F.lit(0)
    light = coded.select(cut.alias("range"), "place", "doc_id", "n", "part", "k")
    counts = sorted((r.range, r.n) for r in light.groupBy("range").agg(F.sum("n").alias("n")).collect())  # at most MOST_RANGES
    begins = np.cumsum([0, *(c for _, c in counts)], dtype=np.int64)[:len(counts)]
    # an Arrow table: a list would start Python workers of another kind on the executors, which stay for a minute
    offsets = spark.createDataFrame(pa.table({"range": pa.array([r for r, _ in counts], pa.int32()), "begins": pa.array(begins)}))
    before = F.sum("n").over(Window.partitionBy("range").orderBy("place", "doc_id", "part", "k").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    places = space.path("places")
    light.join(F.broadcast(offsets), "range").select("part", "k", (F.col("begins") + before).alias("at")).repartition("part").sortWithinPartitions(
        "part", "k").mapInArrow(_note_places(places), "part int").count()
    folder = space.path("shards")
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    dealt = coded.select("part", "k", "doc_id", "ids").mapInArrow(
        _deal(places, n, key, length, per_shard),
        "shard int, slots array<long>, begins array<int>, docs array<long>, sizes array<int>, blob binary")
    tasks = max(1, -(-n // per_shard))
    index = space.keep(
        dealt.repartitionById(tasks, "shard").sortWithinPartitions("shard").mapInArrow(
            _write(folder, length, per_shard, Encoder(ranks.value).end),
            "slot long, shard long, byte_offset long, doc_ids array<long>, n_tokens int"), "index")
    space.drop("coded", "places")
    return index, folder


def read_back(spark: SparkSession, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """(slot, tokens) as the shards hold them, a stride each."""
    stride = 2 * length
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder)
    shard = F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long")
    rows = files.select(shard.alias("shard"), "content", F.explode(
        F.sequence(F.lit(0), (F.col("length") / stride).cast("int") - 1)).alias("k"))
    return rows.select((F.col("shard") * per_shard + F.col("k")).alias("slot"),
                       F.substring("content", F.col("k") * stride + 1, F.lit(stride)).alias("tokens"))
