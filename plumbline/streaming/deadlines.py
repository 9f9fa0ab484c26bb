"""Deadlines in a stream: work that falls due is emitted when the clock passes, with new input or without.

Three keyed tables with versions under one folder:

    state     a key's newest deadline; null where it was cancelled
    queue     (slot, part, key, due): deadlines filed under their slot of time, a slot cut into parts by key
    emitted   (key, due, fired_at): what has been handed out, once for each key and deadline

A tick reads the slots since the last one that emitted, not the state. A deadline that was moved or cancelled leaves its entry in
the queue; it is told by the state when its slot comes up. Every step may be repeated: writes note their batch, entries and
emissions are added only where absent, and the clock moves in the same version as the emissions. Time is always given.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from plumbline.sources.sinks import insert_absent, upsert
from plumbline.sources.versions import Table
from plumbline.streaming.streams import each_batch

STATE = "key string, due timestamp, at timestamp, seq bigint"
EMITTED = "key string, due timestamp, fired_at timestamp"
SLOT_SECONDS, PARTS, BUCKETS = 3600, 8, 64


def slot_of(moment: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(moment) / F.lit(seconds)).cast("bigint")


def _clock(emitted: Table) -> str | None:
    """The time of the last tick that emitted something."""
    manifest = emitted.manifest()
    return manifest.notes.get("clock") if manifest else None


def file_deadlines(rows: DataFrame, path: str, note: tuple[str, str], seconds: int = SLOT_SECONDS, buckets: int = BUCKETS) -> None:
    """Take rows (key, due, at, seq): of each key the greatest (at, seq) counts, however late it comes; a null `due` cancels.

    A deadline before the clock is filed under the clock's slot, so the next tick finds it. Rows without key take no part.
    """
    spark = rows.sparkSession
    state, queue = Table(spark, f"{path}/state"), Table(spark, f"{path}/queue")
    rows = rows.where("key IS NOT NULL").select(
        F.col("key").cast("string").alias("key"), F.col("due").cast("timestamp").alias("due"), F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("bigint").alias("seq"))
    # all deadlines are filed, also those overtaken in this very batch: the state decides when they fall due
    due = slot_of(F.col("due"), seconds)
    clock = _clock(Table(spark, f"{path}/emitted"))
    slot = due if clock is None else F.greatest(due, slot_of(F.lit(clock).cast("timestamp"), seconds))
    entries = rows.where("due IS NOT NULL").select(slot.alias("slot"), F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int").alias("part"), "key", "due")
    queue.commit(
        entries, ["slot", "part"], lambda stored, incoming: insert_absent(stored, incoming, ["slot", "part", "key", "due"], ["key"]), buckets, False, note=note)
    state.commit(rows, ["key"], lambda stored, incoming: upsert(stored, incoming, ["key"], ["at", "seq"]), buckets, True, note=note, columns=STATE)


def deadline_stream(stream: DataFrame, path: str, checkpoint: str, seconds: int = SLOT_SECONDS, buckets: int = BUCKETS) -> StreamingQuery:
    """`file_deadlines` for all that has arrived."""
    return each_batch(stream, checkpoint, lambda batch, number: file_deadlines(batch, path, (checkpoint, str(number)), seconds, buckets))


def due_slots(spark: SparkSession, path: str, now: datetime, seconds: int = SLOT_SECONDS) -> DataFrame:
    """The queue's entries of the slots from the clock to `now`; before the first emission all up to `now`."""
    queue, clock = Table(spark, f"{path}/queue"), _clock(Table(spark, f"{path}/emitted"))
    last = slot_of(F.lit(str(now)).cast("timestamp"), seconds)
    if clock is None:
        return queue.read().where(F.col("slot") <= last)
    first = slot_of(F.lit(clock).cast("timestamp"), seconds)
    slots = spark.range(1).select(F.explode(F.sequence(first, last)).alias("slot"), F.sequence(F.lit(0), F.lit(PARTS - 1)).alias("parts"))
    asked = slots.select("slot", F.explode("parts").alias("part"))
    return queue.read(keys=asked).where(F.col("slot").between(first, last))


def fire(spark: SparkSession, path: str, now: datetime, seconds: int = SLOT_SECONDS, buckets: int = BUCKETS) -> int:
    """Emit every key whose newest deadline is not after `now` and was not emitted before; returns the version of `emitted`.

    `now` must not go back. A tick that is repeated emits nothing more.
    """
    emitted = Table(spark, f"{path}/emitted")
    if not Table(spark, f"{path}/queue").version():
        return emitted.version()
    moment = F.lit(str(now)).cast("timestamp")
    entries = due_slots(spark, path, now, seconds).where(F.col("due") <= moment).select("key", "due").distinct()
    current = Table(spark, f"{path}/state").read(keys=entries.select("key")).where(F.col("due") <= moment).select("key", "due")
    rows = entries.join(current, ["key", "due"], "left_semi").withColumn("fired_at", moment)
    return emitted.commit(
        rows, ["key"], lambda stored, incoming: insert_absent(stored, incoming, ["key", "due"], ["fired_at"]), buckets, False, note=("clock", str(now)), columns=EMITTED)


def sweep(spark: SparkSession, path: str, seconds: int = SLOT_SECONDS, buckets: int = BUCKETS) -> None:
    """Take the entries of slots before the clock's out of the queue; all of them have been emitted or overtaken."""
    queue, clock = Table(spark, f"{path}/queue"), _clock(Table(spark, f"{path}/emitted"))
    if clock is None:
        return
    first = slot_of(F.lit(clock).cast("timestamp"), seconds)
    old = queue.read().where(F.col("slot") < first)
    queue.commit(old, ["slot", "part"], lambda stored, _: stored.where(F.col("slot") >= first), buckets, True)
