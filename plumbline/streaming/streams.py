"""Streaming jobs over keyed tables. Nothing is dropped for being late: a row counts as known only if its key is stored.

Each job runs as `foreachBatch` over what has arrived. A batch becomes one version of the table or none; the version notes the
batch's number, so a batch that is replayed after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from plumbline.operators.quotes import INVALID_PRICE
from plumbline.sources.sinks import upsert, write_run_log
from plumbline.sources.versions import Table

Step = Callable[[DataFrame, int], None]


def each_batch(stream: DataFrame, checkpoint: str, step: Step) -> StreamingQuery:
    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # a write counts its rows by bucket before it merges them
        try:
            step(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_quotes(stream: DataFrame, path: str, checkpoint: str, order: str = "event_id", buckets: int = 64) -> StreamingQuery:
    """History of valid quotes, one per symbol and capture time: the first that arrived, however late."""

    def step(batch: DataFrame, number: int) -> None:
        table = Table(batch.sparkSession, path)
        table.insert_absent(batch.where("valid"), ["symbol", "captured_at"], [order], buckets, note=(checkpoint, str(number)))

    return each_batch(stream, checkpoint, step)


def append_filings(stream: DataFrame, path: str, checkpoint: str, discovered: Callable[[int], Column], buckets: int = 64) -> StreamingQuery:
    """Filings not stored yet, by symbol and accession, each with the time `discovered(batch)` of its first batch."""

    def step(batch: DataFrame, number: int) -> None:
        table = Table(batch.sparkSession, path)
        rows = batch.withColumn("discovered_at", discovered(number))
        table.insert_absent(rows, ["symbol", "accession"], ["filed"], buckets, note=(checkpoint, str(number)))

    return each_batch(stream, checkpoint, step)


def merged_state(stored: DataFrame, batch: DataFrame, order: str = "event_id") -> DataFrame:
    """Last-good state per symbol: price and time of the newest valid quote, and `error` if the newest quote is a bad one.

    A late quote changes neither; `seen_at` and `seen_id` name the newest quote, good or bad.
    """
    seen = F.struct("captured_at", order)
    new = batch.withColumn("captured_at", F.col("captured_at").cast("timestamp")).groupBy("symbol").agg(
        F.max_by(F.struct("price", F.col("captured_at").alias("at")), F.when(F.col("valid"), seen)).alias("good"),
        F.max(F.struct(F.col("captured_at").alias("at"), F.col(order).cast("bigint").alias("id"), "valid")).alias("last"),
    )
    rows = new.join(stored.select("symbol", *(F.col(c).alias(f"_{c}") for c in ("price", "quote_at", "error", "seen_at", "seen_id"))), "symbol", "left")
    newer_good = F.col("good").isNotNull() & (F.col("_quote_at").isNull() | (F.col("good.at") >= F.col("_quote_at")))
    newer = F.col("_seen_at").isNull() | (F.struct("last.at", "last.id") >= F.struct("_seen_at", "_seen_id"))
    return rows.select(
        "symbol", F.when(newer_good, F.col("good.price")).otherwise(F.col("_price")).alias("price"),
        F.when(newer_good, F.col("good.at")).otherwise(F.col("_quote_at")).alias("quote_at"),
        F.when(newer, F.when(~F.col("last.valid"), INVALID_PRICE)).otherwise(F.col("_error")).alias("error"),
        F.when(newer, F.col("last.at")).otherwise(F.col("_seen_at")).alias("seen_at"),
        F.when(newer, F.col("last.id")).otherwise(F.col("_seen_id")).alias("seen_id"),
    )


STATE = "symbol string, price double, quote_at timestamp, error string, seen_at timestamp, seen_id bigint"


def upsert_quotes(stream: DataFrame, path: str, checkpoint: str, order: str = "event_id", buckets: int = 8) -> StreamingQuery:
    """Keep the last-good state of each symbol in a keyed table; bad quotes set the error and leave the price."""

    def merge(stored: DataFrame, batch: DataFrame) -> DataFrame:
        return upsert(stored, merged_state(stored, batch, order), ["symbol"], ["seen_at", "seen_id"])

    def step(batch: DataFrame, number: int) -> None:
        Table(batch.sparkSession, path).commit(batch, ["symbol"], merge, buckets, True, note=(checkpoint, str(number)), columns=STATE)

    return each_batch(stream, checkpoint, step)


def logged(step: Step, source: str, log: str, now: Callable[[int], Column]) -> Step:
    """The step, followed by one log row per batch: status, rows, time `now(batch)`. A failing batch is logged and fails."""

    def run(batch: DataFrame, number: int) -> None:
        spark, status, detail = batch.sparkSession, "ok", ""
        try:
            step(batch, number)
            detail = f"batch {number}; rows {batch.count()}"
        except Exception as error:
            status, detail = "failed", f"batch {number}; {error}"
            raise
        finally:
            row = spark.createDataFrame([(source, status, detail)], "source string, status string, detail string")
            write_run_log(row.withColumn("created_at", now(number)), log)

    return run
