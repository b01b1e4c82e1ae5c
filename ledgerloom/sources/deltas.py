"""Keyed tables that take upserts as deltas and are merged when read.

A table is a folder. Rows live in ``rows/<delivery>/bucket=<n>`` folders, the
bucket being a hash of the keys, so a key's versions always lie in one bucket
number and a delivery writes only its own rows. What belongs to the table is said
by one small text file, ``versions/<n>``: the buckets of each delivery that count.
It is written under another name and renamed last, so a run that dies before that
leaves the table as it was, its rows are in no version, and running it again is
safe. A delivery's name is given by the caller: one that is in already is left
out, so a replayed batch changes nothing.

Reading unions the listed folders and keeps the highest version of each key
(ties: the later delivery). ``compact`` rewrites only buckets that hold several
deliveries; files of other buckets stay as they are. Work is plain DataFrame reads
and writes; one writer at a time (a version number that is taken is refused, so a
second one is noticed, not lost). The number of buckets should follow the size of
the table: a delivery writes at most one file each.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.sinks import latest

BUCKETS = 64


@dataclass
class Delivery:
    """One delivery's folder and the buckets of it that count."""

    name: str
    folder: str
    buckets: list[int]


class _Folder:
    """The few file operations that Spark's readers and writers do not have."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self.path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self.files.listStatus(at)] if self.files.exists(at) else []

    def rename(self, old: str, new: str) -> bool:
        return self.files.rename(self.path(f"{self.root}/{old}"), self.path(f"{self.root}/{new}"))

    def read(self, name: str) -> str:
        stream = self.files.open(self.path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.files.create(self.path(f"{self.root}/{name}"), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.files.delete(self.path(f"{self.root}/{name}"), True)


class DeltaTable:
    """A keyed table at ``root``; the number of buckets is fixed with the first delivery.

    ``version`` names the columns whose highest values win; without them the later
    delivery wins, and of one delivery's rows of a key ``arrival`` says which is last.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType, keys: list[str],
                 version: list[str] | None = None, arrival: list[str] | None = None, buckets: int = BUCKETS):
        if not version and not arrival:
            raise ValueError("name the version columns, or the columns that tell which of a key's rows arrived last")
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.order = [F.desc_nulls_last(c) for c in [*(version or []), *(arrival or [])]]
        self.version = [F.desc_nulls_last(c) for c in version or []]
        self.folder = _Folder(spark, self.root)

    # ------------------------------------------------------------------- versions

    def _current(self) -> tuple[int, list[Delivery]]:
        numbers = [int(n) for n in self.folder.names("versions") if n.isdigit()]
        if not numbers:
            return 0, []
        number = max(numbers)
        listed = json.loads(self.folder.read(f"versions/{number}"))
        self.buckets = listed["buckets"]
        return number, [Delivery(**d) for d in listed["deliveries"]]

    def _publish(self, number: int, deliveries: list[Delivery]) -> None:
        """Make a version the current one; the rename is the moment it counts."""
        staged = f"versions/.{number}-{uuid.uuid4().hex}"
        self.folder.write(staged, json.dumps({"buckets": self.buckets, "deliveries": [vars(d) for d in deliveries]}))
        if f"{number}" in self.folder.names("versions") or not self.folder.rename(staged, f"versions/{number}"):
            self.folder.delete(staged)
            raise RuntimeError(f"version {number} of {self.root} was written by another run; run again")

    def deliveries(self) -> list[Delivery]:
        """What the current version is made of, oldest first."""
        return self._current()[1]

    # --------------------------------------------------------------------- writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        folder = f"rows/{uuid.uuid4().hex}"
        placed = rows.withColumn("bucket", self._bucket())
        placed.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        return folder, sorted(int(n.partition("=")[2]) for n in self.folder.names(folder) if n.startswith("bucket="))

    def upsert(self, rows: DataFrame, delivery: str) -> bool:
        """Add a delivery; False if it is in the table already."""
        number, held = self._current()
        if any(d.name == delivery for d in held):
            return False
        fresh = latest(rows.select(*self.schema.names), self.keys, self.order)
        folder, buckets = self._write(fresh)
        self._publish(number + 1, [*held, Delivery(delivery, folder, buckets)])
        return True

    def compact(self, most: int = 1) -> list[int]:
        """Rewrite the buckets that more than ``most`` deliveries share; returns them. Names of deliveries stay known."""
        number, held = self._current()
        shared = [b for b in range(self.buckets) if sum(b in d.buckets for d in held) > most]
        if shared:
            folder, buckets = self._write(self._merged(held, shared))
            left = [Delivery(d.name, d.folder, [b for b in d.buckets if b not in set(shared)]) for d in held]
            self._publish(number + 1, [*left, Delivery(f"compacted-{number + 1}", folder, buckets)])
        return shared

    def clean(self) -> list[str]:
        """Delete row folders and version files that the current version does not need; returns the folders. Not while others read."""
        number, held = self._current()
        needed = {d.folder.partition("/")[2] for d in held if d.buckets}
        unused = [n for n in self.folder.names("rows") if n not in needed]
        for name in unused:
            self.folder.delete(f"rows/{name}")
        for name in self.folder.names("versions"):
            if name != str(number):
                self.folder.delete(f"versions/{name}")
        return unused

    # --------------------------------------------------------------------- reading

    def _merged(self, held: list[Delivery], buckets: list[int] | None = None) -> DataFrame:
        """The rows that count of some buckets. One scan a delivery: keep them few by ``compact``."""
        parts = None
        for turn, d in enumerate(held):
            wanted = [b for b in d.buckets if buckets is None or b in set(buckets)]
            if wanted:
                paths = [f"{self.root}/{d.folder}/bucket={b}" for b in wanted]
                part = self.spark.read.schema(self.schema).parquet(*paths).withColumn("_turn", F.lit(turn))
                parts = part if parts is None else parts.unionByName(part)
        if parts is None:
            return self.spark.createDataFrame([], self.schema)
        return latest(parts, self.keys, [*self.version, F.desc("_turn")]).select(*self.schema.names)

    def read(self) -> DataFrame:
        """One row per key: that of the highest version, of equal ones the one delivered last."""
        return self._merged(self._current()[1])
