"""Shared folder, Arrow text access and hashing of words without Python strings."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import checkpoint_dir

CHUNK_BYTES = 1 << 18
SLICE_ROWS = 1024
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: One odd multiplier for each place of a word in an n-gram.
PLACE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


class Workspace:
    """Tables of one job in the folder that ``spark.checkpoint.dir`` names.

    A written table ends the lineage: a lost executor costs a re-read. ``drop``
    deletes what no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The rows, written once and read back."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside send their Python functions batches of at most ``rows`` rows, which both sides hold whole."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(column: str, of: int) -> Column:
    """crc32 of the value as text, mod ``of``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """Some texts of an Arrow batch as one byte array; ``rows`` are their places in the batch."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, rows: range):
        self.data, self.starts, self.rows = data, starts, rows

    def __len__(self) -> int:
        return len(self.rows)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES, slice_rows: int = SLICE_ROWS) -> Iterator[Texts]:
    """The texts of a batch (null: empty) in chunks of about ``limit`` bytes, or one longer text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for began in range(0, len(column), slice_rows):  # a whole batch is never held twice
        some = column.slice(began, slice_rows).cast(pa.large_string()).fill_null("")
        _, offsets, data = some.buffers()
        ends = np.frombuffer(offsets, np.int64)[some.offset: some.offset + len(some) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(some):
            last = int(np.searchsorted(ends, ends[first] + limit, "right")) - 1
            last = min(max(last, first + 1), len(some))
            yield Texts(raw[ends[first]: ends[last]], ends[first: last + 1] - ends[first], range(began + first, began + last))
            first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def word_bounds(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes, and the first word of each text (one more at the end)."""
    solid = ~is_space(texts.data)
    edge = np.zeros(len(solid) + 1, bool)
    edge[texts.starts] = True
    before = np.concatenate(([False], solid[:-1])) if len(solid) else solid
    after = np.concatenate((solid[1:], [False])) if len(solid) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, texts.starts)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2^64, kept between chunks."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _POWERS[:] = []
        for base in (_BASE, _BASE_INVERSE):
            row = np.full(size, np.uint64(base))
            row[0] = 1
            _POWERS.append(np.multiply.accumulate(row))
    return _POWERS[0], _POWERS[1]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run: a polynomial over random byte values, by prefix sums."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        weighted = _BYTE[data]
        weighted *= power[: len(data)]
        np.cumsum(weighted, out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def extended(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of ``df`` and further columns."""
    schema = T.StructType(list(df.schema.fields))
    for name, kind in kinds.items():
        schema = schema.add(name, kind)
    return schema


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as the longs Spark knows."""
    return x.view(np.int64)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
