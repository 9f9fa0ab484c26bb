"""Refresh of the symbols that changed, from the first day their change can reach.

Four keyed tables hold what a full run would give, split by a hash of the symbol: compact observations, closing prices, daily
states, and the valid multiples by month. New facts, prices and splits become a change set of one row per symbol with the first
affected day. A refresh reads only the buckets of these symbols, computes their states from that day on and their months from
that month on, and puts the new suffix behind what was stored. Every table moves by one version or not at all.

Why a day bounds a change: an event of the earnings timeline uses what was filed by its date, so a fact filed on a day reaches
states from the next day on; a price reaches its own day; a split restates all events of its symbol.

A rank is then read from the months: one whose multiples all lie at or below the current one counts whole, one above it not at
all, and only the months around the current multiple, and the two at the borders of the window, look at single samples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import periods, valuation
from plumbline.operators.matching import dealt
from plumbline.operators.periods import as_date
from plumbline.sources.versions import Table

STATES = ("symbol string, date date, price double, state string, eps double, eps_filed_at date, eps_period_end date, pe double")
MONTHS = "symbol string, month date, n bigint, least double, most double, samples array<struct<pe:double,date:date>>"


@dataclass(frozen=True)
class Stores:
    """The tables under one folder; `buckets` is fixed when they are made."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def table(self, name: str) -> Table:
        return Table(self.spark, f"{self.path.rstrip('/')}/{name}")


def change_set(obs: DataFrame | None = None, prices: DataFrame | None = None, splits: DataFrame | None = None) -> DataFrame:
    """(symbol, since): the first day that new observations (`filed`), prices (`date`) or splits can change."""
    parts = [] if obs is None else [obs.select("symbol", F.date_add("filed", 1).alias("since"))]
    parts += [] if prices is None else [prices.select("symbol", F.col("date").alias("since"))]
    parts += [] if splits is None else [splits.select("symbol", F.lit("0001-01-01").cast("date").alias("since"))]
    changes = parts[0]
    for part in parts[1:]:
        changes = changes.unionByName(part)
    return changes.where("symbol IS NOT NULL AND since IS NOT NULL").groupBy("symbol").agg(F.min("since").alias("since"))


def _suffix(stored: DataFrame, changes: DataFrame, day: str, since: Column, fresh: DataFrame, tasks: int | None) -> DataFrame:
    """The stored rows before `since`, and the fresh ones."""
    before = dealt(stored, tasks, "symbol").join(changes, "symbol", "left").where(F.col("since").isNull() | (F.col(day) < since)).select(stored.columns)
    return before.unionByName(fresh.select(stored.columns))


def monthly(states: DataFrame) -> DataFrame:
    """Valid multiples of a symbol and month in ascending order, with their number and bounds: at most one per session."""
    valid = states.where((F.col("state") == "valid") & S.finite(F.col("pe")) & (F.col("pe") > 0))
    return valid.groupBy("symbol", F.trunc("date", "MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.min("pe").alias("least"), F.max("pe").alias("most"), F.array_sort(F.collect_list(F.struct("pe", "date"))).alias("samples"))


def refresh(
    stores: Stores, obs: DataFrame | None, prices: DataFrame | None, policy: DataFrame, as_of, splits: DataFrame | None = None, tasks: int | None = None,
) -> DataFrame:
    """Take in new or corrected observations (of `periods.observations`) and prices, and bring the states and months up to date.

    What is known is bounded by `as_of`, so rows that a later `as_of` newly admits are to be among `obs` and `prices`. `splits`
    names symbols (column symbol) whose policy changed. Returns the change set. The first refresh makes the tables. `tasks`: how
    many tasks stored and new rows are dealt to, where the caller knows the size of the tables.
    """
    changes = change_set(obs, prices, splits)

    def take(name: str, rows: DataFrame | None, merge) -> Table:
        table = stores.table(name)
        if rows is not None:
            table.commit(rows, ["symbol"], merge, stores.buckets, True)
        return table

    def newest(stored: DataFrame, incoming: DataFrame) -> DataFrame:
        both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
        return dealt(both, tasks, "symbol", "date").groupBy("symbol", "date").agg(F.max_by("close", "_new").alias("close"))

    def compact(rows: DataFrame) -> DataFrame:
        return periods.compact(dealt(rows, tasks, "symbol", "metric", "start", "end", "filed"))

    facts = take("obs", None if obs is None else compact(obs), lambda stored, incoming: compact(stored.unionByName(incoming)))
    closes = take("prices", None if prices is None else valuation.valid_prices(prices, as_of).select("symbol", "date", "close"), newest)
    changed = changes.select("symbol")
    known = dealt(facts.read(keys=changed), tasks, "symbol").join(changed, "symbol", "left_semi")
    timeline = periods.earnings_timeline(known, policy, as_of, tasks)
    days = dealt(closes.read(keys=changed), tasks, "symbol").join(changes, "symbol").where((F.col("date") >= F.col("since")) & (F.col("date") <= as_date(as_of))).drop("since")
    fresh = valuation.daily_states(days, timeline, tasks)
    states = stores.table("states")
    states.commit(changes, ["symbol"], lambda stored, _: _suffix(stored, changes, "date", F.col("since"), fresh, tasks), stores.buckets, True, columns=STATES)

    month = F.trunc("since", "MM")
    again = monthly(dealt(states.read(keys=changed), tasks, "symbol").join(changes, "symbol").where(F.col("date") >= month))
    months = stores.table("months")
    months.commit(changes, ["symbol"], lambda stored, _: _suffix(stored, changes, "month", month, again, tasks), stores.buckets, True, columns=MONTHS)
    return changes


def rank_from_months(months: DataFrame, current: DataFrame, as_of, years: int = 10) -> DataFrame:
    """Rank of `current` (symbol, pe) among a symbol's valid multiples of the years up to `as_of`; as `pe_percentile` gives."""
    as_of = as_date(as_of)
    start = S.years_before(as_of, years)
    rows = months.where(F.col("month").between(F.trunc(start, "MM"), F.trunc(as_of, "MM"))).join(current.select("symbol", F.col("pe").alias("_pe")), "symbol")
    border = F.col("month").isin(F.trunc(start, "MM"), F.trunc(as_of, "MM"))
    inside = F.when(border, F.filter("samples", lambda s: s["date"].between(start, as_of))).otherwise(F.col("samples"))
    rows = rows.withColumn("inside", inside).withColumn("count", F.size("inside").cast("long")).where(F.col("count") > 0)
    below = (
        F.when(F.col("most") <= F.col("_pe"), F.col("count")).when(F.col("least") > F.col("_pe"), 0)
        .otherwise(F.size(F.filter("inside", lambda s: s["pe"] <= F.col("_pe"))).cast("long"))
    )
    dates = F.transform("inside", lambda s: s["date"])
    return (
        rows.where(S.finite(F.col("_pe")) & (F.col("_pe") > 0)).groupBy("symbol").agg(
            F.max("_pe").alias("pe"), F.sum("count").alias("sample_count"), F.sum(below).alias("_below"),
            F.min(F.array_min(dates)).alias("history_start"), F.max(F.array_max(dates)).alias("history_end"),
            F.min(F.element_at("inside", 1)["pe"]).alias("minimum_pe"), F.max(F.element_at("inside", -1)["pe"]).alias("maximum_pe"))
        .withColumn("percentile", S.half_up(F.lit(100.0) * F.col("_below") / F.col("sample_count"), 2)).drop("_below")
    )
