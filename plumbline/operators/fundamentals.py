"""Snapshots, supplements and native-currency rollups on top of resolved periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators.matching import band_join, dealt, keep_latest
from plumbline.operators.periods import (
    as_date, early, period_type, periods_as_of, standalone_quarters, trailing_eps, trailing_year, with_latest_end,
)
from plumbline.schemas import FLOW_METRICS, SNAPSHOT_VERSION

SNAPSHOT_METRICS = (*FLOW_METRICS, "eps")


def snapshot_basis(periods: DataFrame) -> DataFrame:
    """Per symbol: the latest revenue end, the basis period there, and the end of the quarter before."""
    revenue = with_latest_end(periods.where("metric = 'revenue'"))
    gap = F.datediff("latest_end", "end")
    ends = revenue.groupBy("symbol").agg(F.max(F.when(gap.between(60, 110), F.col("end"))).alias("prior_end"))
    basis = period_type(periods.where("metric = 'revenue'")).select(
        "symbol", F.col("end").alias("period_end"), F.col("start").alias("period_start"), "period_type", "form",
        F.col("accn").alias("accession"))
    return basis.join(ends, "symbol")


def financial_snapshot(periods: DataFrame, tasks: int | None = None) -> DataFrame:
    """One wide row per symbol with revenue: the current period, trailing year, growth and cash deltas.

    Resolved periods are brought together by symbol once. Quarters and whole periods are laid out in long form and folded
    by one aggregate per symbol; trailing sums join on the symbol. All of it keeps the one partitioning. A metric counts
    only on the very period of revenue; anything else stays null. `tasks`: how many tasks the symbols are dealt to, where the
    caller knows the size of the input.
    """
    flows = periods.where(F.col("metric").isin(*SNAPSHOT_METRICS))
    flows = dealt(flows, tasks, "symbol") if tasks else flows.repartition("symbol")
    base = snapshot_basis(flows)
    detail = F.struct("start", "end", "val", "filed", "concept")
    quarters = standalone_quarters(flows).select("symbol", "metric", F.lit("quarter").alias("tag"), detail.alias("r"))
    whole = flows.select("symbol", "metric", F.lit("period").alias("tag"), detail.alias("r"))
    rows = quarters.unionByName(whole)
    rows = (dealt(rows, tasks, "symbol") if tasks else rows.repartition("symbol")).select("symbol", "metric", "tag", "r.*").join(base, "symbol")

    is_quarter = F.col("period_type") == "quarter"
    gap = F.datediff("period_end", "end")
    year_ago = F.abs(gap - 365) <= 14
    tag, metric = F.col("tag"), F.col("metric")
    source = F.when(is_quarter, "quarter").otherwise("period")
    aligned = (tag == source) & (gap == 0) & (F.col("start") == F.col("period_start"))
    folded = []
    for name in SNAPSHOT_METRICS:
        here = metric == name
        folded += [
            F.max(F.when(here & aligned, F.col("val"))).alias(name),
            F.max(F.when(here & aligned, F.col("filed"))).alias(f"{name}_filed"),
        ]
    folded.append(F.max(F.when((metric == "capex") & aligned, F.col("concept"))).alias("capex_concept"))
    for name in ("revenue", "net_income"):
        here = (metric == name) & year_ago
        annual = F.datediff("end", "start") >= 330
        folded += [
            F.max(F.when(here & (tag == "period"), F.col("end"))).alias(f"{name}_year_ago"),
            F.max_by(F.struct("end", "val"), F.when(here & (tag == "quarter"), F.col("end"))).alias(f"{name}_q"),
            F.max_by(F.struct("end", "val"), F.when(here & (tag == "period") & annual, F.struct("end", early(F.col("start"))))).alias(f"{name}_a"),
        ]
    for name in ("operating_cash_flow", "capex"):
        here = (metric == name) & (tag == "quarter") & (F.col("end") == F.col("prior_end"))
        folded.append(F.max(F.when(here, F.struct("start", "val"))).alias(f"{name}_prior"))
    keys = ["symbol", "period_start", "period_end", "period_type", "form", "accession"]
    yearly = trailing_year(flows.where("metric <> 'eps'")).select("symbol", "metric", "end", "val")
    per_share = trailing_eps(flows.where("metric = 'eps'")).select("symbol", F.col("end").alias("_eps_end"), F.col("val").alias("_eps"))
    trailing = yearly.groupBy("symbol").agg(*[
        F.max(F.when(metric == name, F.struct("end", "val"))).alias(f"_{name}") for name in FLOW_METRICS])
    wide = rows.groupBy(*keys).agg(*folded).join(trailing, "symbol", "left").join(per_share, "symbol", "left")
    wide = wide.withColumns({
        **{f"{n}_ttm": F.when(F.col(f"_{n}.end") == F.col("period_end"), F.col(f"_{n}.val")) for n in FLOW_METRICS},
        "eps_ttm": F.when(F.col("_eps_end") == F.col("period_end"), F.col("_eps")),
    })

    def growth(name: str) -> Column:
        prior = F.when(is_quarter, F.col(f"{name}_q")).when(F.col("period_type") == "annual", F.col(f"{name}_a"))
        value = F.when(prior["end"] == F.col(f"{name}_year_ago"), prior["val"])
        return S.percent_change(F.col(name), value)

    cash_then, capex_then = F.col("operating_cash_flow_prior"), F.col("capex_prior")
    comparable = (
        is_quarter & F.col("operating_cash_flow").isNotNull() & F.col("capex").isNotNull()
        & (cash_then["start"] == capex_then["start"])
    )
    cash_delta = F.when(comparable, F.col("operating_cash_flow") - cash_then["val"])
    capex_delta = F.when(comparable, F.col("capex") - capex_then["val"])
    return wide.select(
        "symbol", F.lit(SNAPSHOT_VERSION).alias("schema_version"), F.lit("USD").alias("currency"), "period_type",
        "period_start", "period_end", F.greatest(*[f"{m}_filed" for m in SNAPSHOT_METRICS]).alias("filed_at"),
        "form", "accession", "revenue", "net_income", "operating_income", "operating_cash_flow", "capex",
        S.free_cash_flow(F.col("operating_cash_flow"), F.col("capex")).alias("free_cash_flow"),
        *[f"{m}_ttm" for m in SNAPSHOT_METRICS],
        (F.col("operating_cash_flow_ttm") - F.col("capex_ttm")).alias("free_cash_flow_ttm"),
        growth("revenue").alias("revenue_yoy"), growth("net_income").alias("net_income_yoy"),
        cash_delta.alias("cash_delta"), capex_delta.alias("capex_delta"), (cash_delta - capex_delta).alias("fcf_delta"),
        S.marginal_coverage(cash_delta, capex_delta).alias("marginal_coverage"), "capex_concept",
        is_quarter.alias("quarterly"),
    )


def snapshot_status(periods: DataFrame, snapshot: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """One row per symbol of the periods and of `symbols`, with its snapshot where there is one, and `status`.

    `complete`: a snapshot with trailing-year revenue; `partial`: a snapshot without it; `no_revenue`: periods of other metrics
    only; `no_periods`: a listed symbol without any. The latest end of any metric tells how far the others reach.
    """
    held = periods.groupBy("symbol").agg(F.max("end").alias("latest_end"), F.array_sort(F.collect_set("metric")).alias("_metrics"))
    if symbols is not None:
        held = symbols.select("symbol").where("symbol IS NOT NULL").distinct().join(held, "symbol", "full")
    status = (
        F.when(F.col("revenue_ttm").isNotNull(), "complete").when(F.col("period_end").isNotNull(), "partial")
        .when(F.col("latest_end").isNotNull(), "no_revenue").otherwise("no_periods")
    )
    rows = held.join(snapshot, "symbol", "left").withColumn("status", status)
    return rows.withColumn("metrics", F.array_join(F.coalesce("_metrics", F.array().cast("array<string>")), ",")).drop("_metrics")


def fiscal_quarter(periods: DataFrame, fiscal_calendar: DataFrame) -> DataFrame:
    """Fiscal year and quarter per period end; issuers without an entry in the calendar use calendar quarters."""
    end = F.col("end")
    lookup = fiscal_calendar.select("symbol", F.col("end_month").alias("_month"), "year_offset", F.col("quarter").alias("_quarter"))
    return (
        periods.withColumn("_month", F.month(end)).join(lookup, ["symbol", "_month"], "left")
        .withColumn("fiscal_year", F.year(end) + F.coalesce("year_offset", F.lit(0)))
        .withColumn("fiscal_quarter", F.coalesce("_quarter", F.quarter(end)))
        .drop("_month", "year_offset", "_quarter")
    )


def calendar_quarter_start(periods: DataFrame, calendar_issuers: DataFrame) -> DataFrame:
    """Snap the start to the first day of a calendar quarter for the listed issuers."""
    flags = calendar_issuers.select("symbol", F.lit(True).alias("_snap"))
    start = F.when(F.col("_snap"), F.trunc(F.add_months("end", -2), "MM")).otherwise(F.col("start"))
    return periods.join(flags, "symbol", "left").withColumn("start", start).drop("_snap")


def quarters_without_timely_eps(obs: DataFrame, as_of, years: int = 12) -> DataFrame:
    """Revenue quarters of recent years with no EPS fact for the same period filed within 100 days of its end."""
    as_of = as_date(as_of)
    revenue = periods_as_of(obs.where("metric = 'revenue'"), as_of)
    recent = F.col("end").between(S.years_before(as_of, years), as_of)
    targets = standalone_quarters(revenue).where(recent)
    timely = (
        obs.where((F.col("metric") == "eps") & F.datediff("filed", "end").between(0, 100))
        .select("symbol", "start", "end").distinct()
    )
    return targets.join(timely, ["symbol", "start", "end"], "left_anti")


def first_release(targets: DataFrame, filings: DataFrame) -> DataFrame:
    """The earliest 8-K with item 2.02 filed 1 to 100 days after each period end (left rows without one are kept)."""
    # one release per symbol and day is enough to find the first, and bounds what the join moves
    releases = filings.where((F.col("form") == "8-K") & F.contains(F.col("items"), F.lit("2.02"))).groupBy(
        "symbol", F.col("filed").alias("release_filed")).agg(F.min("accession").alias("release_accession"))
    near = band_join(targets.select("symbol", "end"), releases, ["symbol"], "end", "release_filed", 1, 100)
    first = near.groupBy("symbol", "end").agg(
        F.min(F.struct("release_filed", "release_accession")).alias("r")).select("symbol", "end", "r.*")
    return targets.join(first, ["symbol", "end"], "left")


def supplement_quarters(obs: DataFrame, supplements: DataFrame, filings: DataFrame, as_of, years: int = 12) -> DataFrame:
    """Outcome per quarter lacking timely EPS: `supplied` from the supplement table, else a failure with its reason."""
    missing = first_release(quarters_without_timely_eps(obs, as_of, years), filings)
    given = keep_latest(supplements, ["symbol", "end"], "pos").select("symbol", "end", F.col("val").alias("eps"))
    return missing.join(given, ["symbol", "end"], "left").select(
        "symbol", "start", "end", "eps", "release_filed", "release_accession",
        F.when(F.col("eps").isNotNull(), "supplied")
        .when(F.col("release_filed").isNull(), "release_date_unavailable").otherwise("no_unambiguous_eps").alias("outcome"),
    )


def add_supplements(facts: DataFrame, supplements: DataFrame) -> DataFrame:
    """Facts with supplemental EPS rows appended after them, so a supplement wins an equal filing date."""
    extra = keep_latest(supplements, ["symbol", "end"], "pos").select(
        "symbol", F.lit("us-gaap").alias("taxonomy"), F.lit("EarningsPerShareDiluted").alias("concept"),
        F.lit("USD/shares").alias("unit"), "start", "end", "filed", "form", "accn", "val",
        (F.col("pos") + F.lit(1 << 40)).alias("pos"),
    )
    return facts.unionByName(extra)


def native_currency_annuals(quarters: DataFrame) -> DataFrame:
    """Calendar years made of exactly the four calendar quarters; a sum is null when any of its quarters is."""

    def whole(name: str) -> Column:
        return F.when(F.count(name) == 4, F.sum(name)).alias(name)

    month = F.month("end")
    month_bit = F.when(month == 3, 1).when(month == 6, 2).when(month == 9, 4).when(month == 12, 8).otherwise(16)
    return (
        quarters.groupBy("symbol", F.year("end").alias("year")).agg(
            F.count("*").alias("_n"), F.bit_or(month_bit).alias("_months"),
            whole("revenue"), whole("net_income"),
        )
        .where((F.col("_n") == 4) & (F.col("_months") == 15))
        .select(
            "symbol", F.make_date("year", F.lit(1), F.lit(1)).alias("period_start"),
            F.make_date("year", F.lit(12), F.lit(31)).alias("period_end"), "revenue", "net_income",
            F.lit(None).cast("double").alias("free_cash_flow"),
        )
    )


def native_currency_snapshot(quarters: DataFrame, cash_lines: DataFrame, currency: str = "TWD") -> DataFrame:
    """Snapshot of an issuer that reports in its own currency; amounts are never converted.

    `quarters` has revenue and income per quarter end; `cash_lines` has this and the previous column of operating
    income, operating cash flow and capital expenditure for the latest quarter.
    """
    last = quarters.groupBy("symbol").agg(F.max("end").alias("_last"))
    ranked = quarters.join(last, "symbol")
    # the last four listed quarters, whatever their dates, make the trailing year
    tail = F.slice(F.sort_array(F.collect_list(F.struct("end", "net_income")), asc=False), 1, 4)
    ttm = quarters.groupBy("symbol").agg(tail.alias("_tail"))
    now = ranked.where(F.col("end") == F.col("_last"))
    year_ago = quarters.select(
        "symbol", F.col("end").alias("_then"), F.col("revenue").alias("_revenue"), F.col("net_income").alias("_income"))
    rows = (
        now.withColumn("_then", F.add_months("end", -12)).join(year_ago, ["symbol", "_then"], "left")
        .join(ttm, "symbol").join(cash_lines, ["symbol", "end"], "left")
    )
    capex, capex_before = F.abs("capex"), F.abs("capex_previous")
    cash_delta = F.col("operating_cash_flow") - F.col("operating_cash_flow_previous")
    capex_delta = capex - capex_before
    income = F.transform("_tail", lambda x: x["net_income"])
    total = F.aggregate(F.reverse(income), F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "symbol", F.lit(SNAPSHOT_VERSION).alias("schema_version"), F.lit(currency).alias("currency"),
        F.lit("quarter").alias("period_type"), F.col("start").alias("period_start"), F.col("end").alias("period_end"),
        "revenue", "net_income", "operating_income", "operating_cash_flow", capex.alias("capex"),
        (F.col("operating_cash_flow") - capex).alias("free_cash_flow"),
        S.percent_change(F.col("revenue"), F.col("_revenue")).alias("revenue_yoy"),
        S.percent_change(F.col("net_income"), F.col("_income")).alias("net_income_yoy"),
        cash_delta.alias("cash_delta"), capex_delta.alias("capex_delta"),
        (cash_delta - capex_delta).alias("fcf_delta"),
        F.when(capex_delta > 0, cash_delta / capex_delta).alias("marginal_coverage"), total.alias("net_income_ttm"),
        F.when(F.col("operating_cash_flow").isNull() | F.col("capex").isNull(), "cash_lines_missing").otherwise("ok").alias("status"),
    )


def scenario_fingerprint(*columns: str) -> Column:
    """Changes with financial evidence or assumptions; give it no quote columns."""
    return S.content_hash(*columns)

