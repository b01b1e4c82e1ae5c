"""Keyed tables of deltas: what wins, what a crash leaves behind, what compaction touches."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import deltas
from ledgerloom.streaming import events

SCHEMA = "id long, version long, status string"


@pytest.fixture()
def table(spark, tmp_path):
    return deltas.DeltaTable(spark, str(tmp_path / "table"), SCHEMA, ["id"], ["version"], buckets=8)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(table):
    return {r.id: (r.version, r.status) for r in table.read().collect()}


def files(table):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns
            for d, _, names in os.walk(f"{table.root}/rows") for n in names if n.endswith(".parquet")}


def test_highest_version_wins_and_a_replay_changes_nothing(spark, table):
    assert held(table) == {}
    assert table.upsert(rows(spark, (1, 1, "a"), (2, 5, "b"), (2, 4, "old"), (None, 1, "n")), "first")
    assert table.upsert(rows(spark, (1, 2, "c"), (2, 3, "late"), (3, 1, "d"), (None, 1, "m")), "second")
    wanted = {1: (2, "c"), 2: (5, "b"), 3: (1, "d"), None: (1, "m")}
    assert held(table) == wanted
    assert not table.upsert(rows(spark, (1, 9, "again")), "second")
    assert held(table) == wanted


def test_without_version_or_arrival_there_is_no_winner(spark, tmp_path):
    with pytest.raises(ValueError):
        deltas.DeltaTable(spark, str(tmp_path / "t"), SCHEMA, ["id"])


def test_later_delivery_wins_by_arrival(spark, tmp_path):
    table = deltas.DeltaTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], arrival=["version"], buckets=4)
    table.upsert(rows(spark, (1, 7, "a"), (1, 8, "b")), "x")
    table.upsert(rows(spark, (1, 2, "c"), (1, 1, "d")), "y")
    assert held(table) == {1: (2, "c")}


@pytest.mark.parametrize("step", ["upsert", "compact"])
def test_a_death_between_the_two_writes_leaves_the_table_as_it_was(spark, table, monkeypatch, step):
    table.upsert(rows(spark, *[(i, 1, "a") for i in range(20)]), "first")
    table.upsert(rows(spark, *[(i, 2, "b") for i in range(5)]), "second")
    before = held(table)
    work = (lambda: table.upsert(rows(spark, (1, 3, "c"), (99, 1, "new")), "third")) if step == "upsert" else table.compact

    def dies(*_):
        raise OSError("the driver died")

    with monkeypatch.context() as m:
        m.setattr(table.folder, "rename", dies)
        with pytest.raises(OSError):
            work()
    assert held(table) == before
    work()
    assert held(table) == (before | {1: (3, "c"), 99: (1, "new")} if step == "upsert" else before)
    assert table.clean()  # the rows of the run that died
    assert held(table) == (before | {1: (3, "c"), 99: (1, "new")} if step == "upsert" else before)


def test_a_second_writer_is_noticed(spark, table, monkeypatch):
    table.upsert(rows(spark, (1, 1, "a")), "first")
    other = deltas.DeltaTable(spark, table.root, SCHEMA, ["id"], ["version"], buckets=8)
    write = other._write

    def meanwhile(fresh):
        table.upsert(rows(spark, (2, 1, "b")), "second")
        return write(fresh)

    monkeypatch.setattr(other, "_write", meanwhile)
    with pytest.raises(RuntimeError, match="another run"):
        other.upsert(rows(spark, (3, 1, "c")), "third")
    monkeypatch.undo()
    assert other.upsert(rows(spark, (3, 1, "c")), "third")
    assert sorted(held(table)) == [1, 2, 3]


def test_compaction_leaves_untouched_buckets_their_files(spark, table):
    table.upsert(rows(spark, *[(i, 1, "a") for i in range(200)]), "first")
    table.upsert(rows(spark, (7, 2, "b")), "second")
    old, before = files(table), held(table)
    touched = table.compact()
    assert len(touched) == 1
    assert held(table) == before
    table.clean()
    kept = files(table)
    same = {p for p in old if p in kept and old[p] == kept[p]}
    assert {p.split("bucket=")[1].split("/")[0] for p in same} >= {str(b) for b in range(8)} - {str(touched[0])}
    assert not table.compact()
    assert not table.upsert(rows(spark, (7, 3, "c")), "second")  # still known
    assert len([d for d in table.deliveries() if d.buckets]) == 2


def test_a_delivery_writes_its_own_rows_only(spark, table):
    table.upsert(spark.range(5000).select("id", F.lit(1).cast("long").alias("version"), F.lit("a").alias("status")), "first")
    before = files(table)
    table.upsert(rows(spark, (7, 2, "b")), "second")
    new = set(files(table)) - set(before)
    assert {p: t for p, t in files(table).items() if p in before} == before
    assert spark.read.schema(SCHEMA).parquet(*new).count() == 1


def test_stream_restarted_in_the_middle(spark, tmp_path):
    def deliver(number):
        batch = spark.range(40).select("id", F.lit(number).cast("long").alias("version"), F.lit(f"s{number}").alias("status"))
        batch.where(f"id % {number} = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(target, **how):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        events.run_upsert(stream, target, str(tmp_path / "state"), ["id"], ["version"], buckets=4, **how)

    wanted = {i: max(n for n in (1, 2, 3, 4) if i % n == 0) for i in range(40)}
    target = str(tmp_path / "table")
    for number in (1, 2):
        deliver(number)
    run(target)

    calls = []

    def dies(*_):
        calls.append(1)
        raise RuntimeError("after the batch is in, before it is known to be done")

    for number in (3, 4):
        deliver(number)
    with pytest.raises(Exception):
        run(target, after=dies)
    assert calls
    run(target)
    table = deltas.DeltaTable(spark, target, SCHEMA, ["id"], ["version"])
    assert {r.id: r.version for r in table.read().collect()} == wanted
    names = [d.name for d in table.deliveries() if not d.name.startswith("compacted")]
    assert names == ["batch-0", "batch-1", "batch-2", "batch-3"]
