"""Quotes and keyed state: last good values, merges, freshness and work lists. Time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators.matching import top_n_per_key
from plumbline.schemas import ALGORITHM_VERSION, QUALITY_VERSION, SNAPSHOT_VERSION

INVALID_PRICE = "invalid_price_kept_previous"
NO_QUOTE = "no_quote_kept_previous"


def clean_quotes(quotes: DataFrame) -> DataFrame:
    """Typed quotes with `valid`: a positive price."""
    rows = quotes.withColumns({
        "symbol": F.upper("symbol"), "price": S.clean_number(F.col("last")),
        "change_percent": S.clean_number(F.col("change_pct")),
        "volume": S.clean_number(F.col("volume")).cast("long"),
    })
    return rows.withColumn("valid", F.coalesce(F.col("price") > 0, F.lit(False))).drop("last", "change_pct")


def accepted_quotes(quotes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Valid quotes of known symbols."""
    return quotes.where("valid").join(symbols.select("symbol"), "symbol", "left_semi")


def missing_symbols(requested: DataFrame, received: DataFrame) -> DataFrame:
    """Requested symbols without any row; the received side is reduced to distinct symbols before it is shuffled."""
    return requested.select("symbol").join(received.select("symbol").distinct(), "symbol", "left_anti")


def last_good_quotes(previous: DataFrame, batch: DataFrame) -> DataFrame:
    """State per symbol after a batch: the newest valid quote survives bad or missing ones, which only set `error`.

    `previous` has (symbol, price, quote_at, error) and names the known symbols. The newest row of the batch decides
    the error; aggregates only, so a busy symbol is reduced before the shuffle.
    """
    newest = batch.groupBy("symbol").agg(
        F.max_by(F.struct("price", F.col("captured_at").alias("quote_at")), F.when(F.col("valid"), F.struct("captured_at", "event_id"))).alias("good"),
        F.max_by("valid", F.struct("captured_at", "event_id")).alias("last_valid"),
    )
    rows = previous.join(newest, "symbol", "left")
    return rows.select(
        "symbol", F.coalesce("good.price", "price").alias("price"), F.coalesce("good.quote_at", "quote_at").alias("quote_at"),
        F.when(F.col("last_valid").isNull(), NO_QUOTE).when(~F.col("last_valid"), INVALID_PRICE).alias("error"),
    )


def quote_history(quotes: DataFrame, n: int = 240, salts: int = 32) -> DataFrame:
    """The last `n` quotes per symbol, in ascending order of symbol and time."""
    return top_n_per_key(quotes, ["symbol"], [F.desc("captured_at"), F.desc("event_id")], n, salts).orderBy("symbol", "captured_at", "event_id")


def merge_keep_last_good(current: DataFrame, incoming: DataFrame, keep: list[str], clearable: list[str]) -> DataFrame:
    """Full outer merge by symbol. `keep` columns stay when the incoming value is null; `clearable` ones stay only when
    the incoming row leaves them out (`<name>_present` is false), so an explicit null clears them."""
    left = current.select("symbol", *[F.col(c).alias(f"_{c}") for c in (*keep, *clearable)])
    rows = left.join(incoming.withColumn("_in", F.lit(True)), "symbol", "full")
    kept = [F.coalesce(c, f"_{c}").alias(c) for c in keep]
    cleared = [
        F.when(F.col("_in") & F.col(f"{c}_present"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in clearable
    ]
    return rows.select("symbol", *kept, *cleared)


def cache_freshness(state: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """One row: the newest update and whether it is older than the time to live (or absent)."""
    return state.agg(F.max("updated_at").alias("latest")).withColumn(
        "stale", F.col("latest").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("latest") > ttl_seconds))


def facts_due(state: DataFrame, now: Column, ttl_hours: int = 24, force: bool = False) -> DataFrame:
    """Companies whose snapshot has an old version or age."""
    age = F.unix_timestamp(now) - F.unix_timestamp("facts_updated_at")
    fresh = (
        (F.col("schema_version") == SNAPSHOT_VERSION) & (F.col("quality_version") == QUALITY_VERSION)
        & F.col("facts_updated_at").isNotNull() & (age < ttl_hours * 3600)
    )
    return state.where(F.lit(force) | ~F.coalesce(fresh, F.lit(False)))


def valuations_due(state: DataFrame, now: Column, force: bool = False, ttl_hours: int = 6, retry_minutes: int = 5) -> DataFrame:
    """Valuations to recompute: other version, or older than six hours; five minutes while pending, failed or withheld."""
    retrying = (
        F.coalesce(F.col("pending"), F.lit(False)) | F.col("valuation_error").isNotNull()
        | F.coalesce(F.col("status").isin("incomplete", "stale", "withdrawn"), F.lit(False))
    )
    ttl = F.when(retrying, retry_minutes * 60).otherwise(ttl_hours * 3600)
    age = F.unix_timestamp(now) - F.unix_timestamp("valuation_updated_at")
    fresh = (F.col("algorithm_version") == ALGORITHM_VERSION) & F.col("valuation_updated_at").isNotNull() & (age < ttl)
    return state.withColumn("retrying", retrying).where(F.lit(force) | ~F.coalesce(fresh, F.lit(False)))


def run_outcome(results: DataFrame, by: list[str]) -> DataFrame:
    """Updated and failed counts with `ok` or `partial`."""
    return results.groupBy(*by).agg(
        F.count_if("valid").alias("updated"), F.count_if(~F.col("valid")).alias("failed"),
    ).withColumn("status", F.when(F.col("failed") > 0, "partial").otherwise("ok"))


def publish_if_current(results: DataFrame, current: DataFrame, version: str = "input_hash") -> DataFrame:
    """Results computed from inputs that are still current, with `accepted`; the rest go back to the work list."""
    latest = current.select("symbol", F.col(version).alias("_now"))
    return results.join(latest, "symbol", "left").withColumn(
        "accepted", F.coalesce(F.col(version) == F.col("_now"), F.lit(False))).drop("_now")


def tracked_order(companies: DataFrame) -> DataFrame:
    return companies.orderBy("tracked_at", "symbol")
