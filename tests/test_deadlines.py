"""Deadlines: emitted when the clock passes, moved, cancelled, late and repeated ones, with and without input."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from plumbline.sources.versions import Table
from plumbline.streaming import deadlines

ROWS = "key string, due timestamp, at timestamp, seq long"
START = datetime(2026, 3, 2, 9, 0)


def minute(n):
    return START + timedelta(minutes=n)


class Queue:
    def __init__(self, spark, path):
        self.spark, self.path, self.batch = spark, path, 0

    def give(self, *rows, number=None):
        """Rows (key, minute due or None, minute of the event)."""
        self.batch += 1
        made = [(k, None if due is None else minute(due), minute(at), i) for i, (k, due, at) in enumerate(rows)]
        deadlines.file_deadlines(self.spark.createDataFrame(made, ROWS), self.path, ("test", str(number or self.batch)), 600, 8)

    def tick(self, at):
        deadlines.fire(self.spark, self.path, minute(at), 600, 8)

    def emitted(self):
        rows = Table(self.spark, f"{self.path}/emitted").read().collect()
        return sorted((r["key"], int((r["due"] - START).total_seconds() // 60), int((r["fired_at"] - START).total_seconds() // 60)) for r in rows)


@pytest.fixture
def queue(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Queue(spark, str(tmp_path / "deadlines"))


def test_the_clock_alone_emits(queue):
    queue.give(("a", 5, 0), ("b", 65, 0), ("c", 66, 0), (None, 1, 0))
    queue.tick(4)
    assert queue.emitted() == []
    queue.tick(5)
    queue.tick(5)
    assert queue.emitted() == [("a", 5, 5)]
    queue.tick(65)
    assert queue.emitted() == [("a", 5, 5), ("b", 65, 65)]
    queue.tick(500)
    assert queue.emitted()[-1] == ("c", 66, 500)


def test_moved_cancelled_late_and_past_deadlines(queue):
    queue.give(("moved", 10, 0), ("cancelled", 10, 0), ("kept", 10, 5), ("seen", 1, 0))
    queue.tick(2)
    queue.give(("moved", 50, 1), ("cancelled", None, 1), ("kept", 90, 4), ("past", -300, 2))  # `kept` is late: an older event
    queue.tick(12)
    assert queue.emitted() == [("kept", 10, 12), ("past", -300, 12), ("seen", 1, 2)]
    queue.tick(49)
    assert len(queue.emitted()) == 3
    queue.tick(50)
    assert queue.emitted()[1] == ("moved", 50, 50) and len(queue.emitted()) == 4


def test_repeated_batches_and_ticks_change_nothing(queue):
    queue.give(("a", 5, 0), number=7)
    queue.give(("a", 9, 9), number=7)  # the batch has been done
    queue.tick(5)
    before = queue.emitted()
    queue.tick(5)
    assert queue.emitted() == before == [("a", 5, 5)]


def test_a_tick_reads_the_slots_since_the_clock_and_a_sweep_drops_older_ones(spark, queue):
    queue.give(*[(f"k{i}", i * 10, 0) for i in range(40)])
    queue.tick(100)
    assert {r["key"] for r in deadlines.due_slots(spark, queue.path, minute(120), 600).collect()} == {"k10", "k11", "k12"}
    deadlines.sweep(spark, queue.path, 600, 8)
    assert Table(spark, f"{queue.path}/queue").read().count() == 30
    queue.tick(390)
    assert len(queue.emitted()) == 40
    deadlines.sweep(spark, queue.path, 600, 8)
    assert [r["key"] for r in Table(spark, f"{queue.path}/queue").read().collect()] == ["k39"]


def test_an_empty_queue_emits_nothing(spark, queue):
    assert deadlines.fire(spark, queue.path, minute(1), 600, 8) == 0
    deadlines.sweep(spark, queue.path, 600, 8)
    queue.give(("a", None, 0))
    assert deadlines.fire(spark, queue.path, minute(1), 600, 8) <= 1 and queue.emitted() == []
