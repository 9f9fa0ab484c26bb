"""The package's operators applied to the fixture views; shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from plumbline.operators import filings, fundamentals, periods, quality, valuation
from plumbline.plans import fixtures as fx
from plumbline.schemas import concept_map
from plumbline.session import input_tasks, landed

AS_OF = fx.AS_OF


def today() -> Column:
    return F.lit(AS_OF).cast("date")


def raw_obs(spark: SparkSession, sf: str) -> DataFrame:
    return periods.observations(fx.facts(spark, sf), concept_map(spark))


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Compact observations, stored by metric so that a reader of one metric reads nothing else."""
    def build() -> DataFrame:
        return periods.compact(raw_obs(spark, sf).repartition(input_tasks(spark, sf), "symbol", "metric", "start", "end", "filed"))

    return landed(spark, sf, "obs", build, partition_by=("metric",))


def current_periods(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        return periods.periods_as_of(obs(spark, sf).repartition(input_tasks(spark, sf), "symbol", "metric", "start", "end"), AS_OF)

    return landed(spark, sf, "periods", build, partition_by=("metric",))


def instants(spark: SparkSession, sf: str) -> DataFrame:
    return landed(spark, sf, "instants", lambda: quality.instant_rows(fx.facts(spark, sf), concept_map(spark)))


def clean_prices(spark: SparkSession, sf: str) -> DataFrame:
    return valuation.valid_prices(fx.prices(spark, sf), AS_OF)


def build_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return periods.earnings_timeline(obs(spark, sf), fx.splits(spark, sf), AS_OF, series_tasks(spark, sf))


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return landed(spark, sf, "timeline", lambda: build_timeline(spark, sf))


def build_states(spark: SparkSession, sf: str) -> DataFrame:
    return valuation.daily_states(clean_prices(spark, sf), build_timeline(spark, sf), series_tasks(spark, sf))


def states(spark: SparkSession, sf: str) -> DataFrame:
    return landed(spark, sf, "states", lambda: build_states(spark, sf))


def series_tasks(spark: SparkSession, sf: str) -> int:
    """Tasks for the daily series: their steps sort each row several times at once, so a task gets less of it."""
    return input_tasks(spark, sf, 4 << 20)


def dealt_states(spark: SparkSession, sf: str) -> DataFrame:
    """The states, each symbol in one of many tasks: windows over a symbol read them as they lie."""
    return states(spark, sf).repartition(series_tasks(spark, sf), "symbol")


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return valuation.coverage_windows(dealt_states(spark, sf), fx.calendar(spark, sf), AS_OF)


def selected(spark: SparkSession, sf: str) -> DataFrame:
    """Each symbol's horizon, counted once for all that read it."""
    return landed(spark, sf, "selected", lambda: valuation.selected_horizon(windows(spark, sf)))


def build_summary(spark: SparkSession, sf: str) -> DataFrame:
    return valuation.valuation_summary(
        clean_prices(spark, sf), dealt_states(spark, sf), fx.splits(spark, sf), fx.calendar(spark, sf), AS_OF,
        selected=selected(spark, sf))


def summary(spark: SparkSession, sf: str) -> DataFrame:
    return landed(spark, sf, "summary", lambda: build_summary(spark, sf))


def build_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return fundamentals.financial_snapshot(current_periods(spark, sf), series_tasks(spark, sf))


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return landed(spark, sf, "snapshot", lambda: build_snapshot(spark, sf))


def build_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_of(current_periods(spark, sf), instants(spark, sf), snapshot(spark, sf), AS_OF, series_tasks(spark, sf))


def quality_record(spark: SparkSession, sf: str) -> DataFrame:
    return landed(spark, sf, "quality", lambda: build_quality(spark, sf))


def pending(spark: SparkSession, sf: str) -> DataFrame:
    latest = filings.latest_filing(filings.relevant_filings(fx.nation_filings(spark, sf)))
    return filings.pending_report(latest, snapshot(spark, sf))


def build_companies(spark: SparkSession, sf: str) -> DataFrame:
    """One row per symbol: snapshot, valuation, quality columns with prefix `q_`, and `pending`."""
    shots = snapshot(spark, sf)
    marks = quality_record(spark, sf)
    marks = marks.select("symbol", *[F.col(c).alias(f"q_{c}") for c in marks.columns if c != "symbol"])
    values = summary(spark, sf).select(
        "symbol", "algorithm_version", "status", "current_pe_qualified", "frequency", F.col("as_of").alias("priced_on"), "price",
        "pe", F.col("eps_period_end"), "horizon_years", "percentile", "percentile10y")
    waiting = pending(spark, sf).select("symbol", "pending")
    return (
        shots.join(values, "symbol", "left").join(marks, "symbol", "left").join(waiting, "symbol", "left")
        .withColumn("pending", F.coalesce("pending", F.lit(False)))
    )


def companies(spark: SparkSession, sf: str) -> DataFrame:
    return landed(spark, sf, "companies", lambda: build_companies(spark, sf))
