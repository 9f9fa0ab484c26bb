"""Keyed tables with versions: whole or not at all, no lost rows, refused or repeated writes, guarded publishing."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.sources.sinks import upsert
from plumbline.sources.versions import Moved, Table, publish_guarded, with_bucket

SCHEMA = "k string, v int, at int"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def held(table, version=None):
    return sorted((r["k"], r["v"]) for r in table.read(version).collect())


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, str(tmp_path / "table"))


def test_upsert_and_insert_absent(spark, table, tmp_path):
    assert table.version() == 0 and table.upsert(frame(spark, ("a", 1, 1), ("b", 1, 1), ("a", 0, 0)), ["k"], ["at"], 4) == 1
    assert table.upsert(frame(spark, ("a", 2, 2), ("c", 3, 2), ("b", 0, 0)), ["k"], ["at"], 4) == 2
    assert held(table) == [("a", 2), ("b", 1), ("c", 3)] and held(table, 1) == [("a", 1), ("b", 1)]
    with pytest.raises(ValueError, match="buckets"):
        table.upsert(frame(spark, ("z", 1, 1)), ["k"], ["at"], 8)
    with pytest.raises(ValueError, match="columns"):
        table.upsert(frame(spark, ("z", 1, 1)).withColumn("more", F.lit(1)), ["k"], ["at"], 4)
    log = Table(spark, str(tmp_path / "log"))
    log.insert_absent(frame(spark, ("a", 1, 1), ("a", 2, 2)), ["k"], ["at"])
    first = log.manifest().files
    log.insert_absent(frame(spark, ("a", 9, 9), ("d", 4, 1)), ["k"], ["at"])
    assert held(log) == [("a", 1), ("d", 4)]
    assert all(log.manifest().files[b][: len(c)] == c for b, c in first.items())
    assert log.insert_absent(frame(spark, ("a", 1, 1)).limit(0), ["k"], ["at"]) == 2
    with pytest.raises(FileNotFoundError):
        Table(spark, str(tmp_path / "none")).read()


def test_a_write_reads_and_replaces_only_its_buckets(spark, table):
    rows = spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"), F.lit(1).alias("at"))
    table.upsert(rows, ["k"], ["at"], 16)
    before = table.manifest()
    one = rows.where("k = '7'").withColumn("v", F.lit(2))
    assert 0 < table.read(keys=one.select("k")).count() < 40
    table.upsert(one, ["k"], ["at"], 16)
    after = table.manifest()
    bucket = str(with_bucket(one, ["k"], 16).first()["bucket"])
    assert {b for b in after.files if after.files[b] != before.files[b]} == {bucket}
    assert table.read().count() == sum(after.rows.values()) == 200 and held(table).count(("7", 2)) == 1


def test_a_writer_that_dies_leaves_the_old_state(spark, table, monkeypatch):
    table.upsert(frame(spark, ("a", 1, 1), ("b", 1, 1)), ["k"], ["at"], 4)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Table, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            table.upsert(frame(spark, ("a", 2, 2), ("c", 2, 2)), ["k"], ["at"], 4)
    assert held(table) == [("a", 1), ("b", 1)] and table.version() == 1
    folders = {p.name for p in Path(table.path, "data").iterdir()}
    assert len(folders) == 2
    table.upsert(frame(spark, ("a", 3, 3)), ["k"], ["at"], 4)
    assert held(table) == [("a", 3), ("b", 1)]
    assert table.vacuum() == 1 and table.versions() == [2] and held(table) == [("a", 3), ("b", 1)]


def test_a_writer_overtaken_in_its_bucket_merges_again(spark, table):
    table.upsert(frame(spark, ("a", 1, 1)), ["k"], ["at"], 1)
    merges = []

    def merge(stored, incoming):
        merges.append(1)
        if len(merges) == 1:
            table.upsert(frame(spark, ("b", 5, 5), ("a", 7, 7)), ["k"], ["at"], 1)
        return upsert(stored, incoming, ["k"], ["at"])

    assert table.commit(frame(spark, ("a", 2, 2), ("c", 2, 2)), ["k"], merge, 1, True) == 3
    assert len(merges) == 2 and held(table) == [("a", 7), ("b", 5), ("c", 2)]


def test_a_writer_overtaken_elsewhere_keeps_its_files(spark, table):
    names = [f"k{i}" for i in range(40)]
    table.upsert(frame(spark, *((n, 0, 0) for n in names)), ["k"], ["at"], 8)
    buckets = {r["k"]: r["bucket"] for r in with_bucket(frame(spark, *((n, 0, 0) for n in names)), ["k"], 8).collect()}
    mine = names[0]
    other = next(n for n in names if buckets[n] != buckets[mine])
    merges = []

    def merge(stored, incoming):
        merges.append(1)
        table.upsert(frame(spark, (other, 5, 5)), ["k"], ["at"], 8)
        return upsert(stored, incoming, ["k"], ["at"])

    table.commit(frame(spark, (mine, 2, 2)), ["k"], merge, 8, True)
    assert len(merges) == 1 and dict(held(table)) == {n: 0 for n in names} | {mine: 2, other: 5}


def test_writers_side_by_side_lose_nothing(spark, table):
    def write(i):
        return table.insert_absent(frame(spark, *((f"{i}-{j}", i, j) for j in range(5))), ["k"], ["at"], 2)

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(write, range(6)))
    assert sorted(versions) == list(range(1, 7)) and table.read().count() == 30


def test_expected_versions_and_notes(spark, table):
    table.upsert(frame(spark, ("a", 1, 1)), ["k"], ["at"], 2, expected=0)
    with pytest.raises(Moved):
        table.upsert(frame(spark, ("a", 2, 2)), ["k"], ["at"], 2, expected=0)
    table.upsert(frame(spark, ("a", 3, 3)), ["k"], ["at"], 2, note=("job", "1"))
    assert table.upsert(frame(spark, ("a", 4, 4)), ["k"], ["at"], 2, note=("job", "1")) == 2
    assert table.upsert(frame(spark, ("a", 5, 5)), ["k"], ["at"], 2, note=("job", "2")) == 3 and held(table) == [("a", 5)]
    with pytest.raises(Moved):
        table._publish(table.manifest())


def test_publishing_is_checked_against_one_version_of_the_inputs(spark, table, tmp_path, monkeypatch):
    inputs, columns = Table(spark, str(tmp_path / "inputs")), "k string, input_hash string"
    inputs.upsert(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], columns), ["k"], [], 2)
    results = spark.createDataFrame([("a", "1", 10), ("b", "1", 20), ("c", "1", 30), ("d", "1", 40)], f"{columns}, v int")
    write, calls = Table._write, []

    def moving(self, *arguments):
        done = write(self, *arguments)
        if self.path == table.path and not calls:
            calls.append(1)  # the inputs of b change after its result was checked
            inputs.upsert(spark.createDataFrame([("b", "2")], columns), ["k"], [], 2)
        return done

    monkeypatch.setattr(Table, "_write", moving)
    waiting = publish_guarded(results, inputs, table, ["k"], buckets=2)
    assert calls and held(table) == [("a", 10)] and sorted(r["k"] for r in waiting.collect()) == ["b", "c", "d"]
    publish_guarded(spark.createDataFrame([("a", "1", 11)], f"{columns}, v int"), inputs, table, ["k"], buckets=2)
    assert held(table) == [("a", 11)]
