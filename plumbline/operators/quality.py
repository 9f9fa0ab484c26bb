"""Balance-sheet and multi-year quality measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators.matching import dealt, lookup_join
from plumbline.operators.periods import (
    as_date, observations, periods_as_of, standalone_quarters, trailing_year,
)
from plumbline.schemas import INSTANT_CONCEPTS, QUALITY_VERSION, taxonomy_rank

HISTORY_METRICS = ("revenue", "net_income", "operating_income", "operating_cash_flow", "capex", "share_compensation")


def instant_rows(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """Accepted balance facts: no start, known form and taxonomy, finite value."""
    rows = facts.withColumn("taxonomy_rank", taxonomy_rank("taxonomy")).where(
        F.col("start").isNull() & F.col("end").isNotNull() & F.col("filed").isNotNull()
        & F.col("taxonomy_rank").isNotNull() & S.accepted_form(F.col("form")) & S.finite(F.col("val"))
    )
    return lookup_join(rows, concepts, ["concept", "unit"], ["symbol", "end", "filed"])


def instant_facts(rows: DataFrame, ends: DataFrame, as_of, tasks: int | None = None) -> DataFrame:
    """The winning balance fact per (symbol, metric, end) for the asked ends: latest filed, preferred tag, first listed."""
    order = F.struct("filed", -F.col("priority"), -F.col("taxonomy_rank"), -F.col("pos"))
    return (
        dealt(rows.where(F.col("filed") <= as_date(as_of)), tasks, "symbol", "end").join(ends.select("symbol", "end"), ["symbol", "end"], "left_semi")
        .groupBy("symbol", "metric", "end").agg(F.max_by(F.struct("val", "filed", "accn", "concept"), order).alias("w"))
        .select("symbol", "metric", "end", "w.*")
    )


def annual_history(periods: DataFrame, years: int = 6) -> DataFrame:
    """The last annual revenue periods with the other metrics on the very same period."""
    aligned = periods.where(F.col("metric").isin(*HISTORY_METRICS)).groupBy("symbol", "start", "end").pivot(
        "metric", list(HISTORY_METRICS)).agg(F.first("val"))
    revenue = periods.where((F.col("metric") == "revenue") & S.annual_span(F.datediff("end", "start")))
    annual = (
        revenue.groupBy("symbol", "end").agg(F.max(F.struct("start", "filed", "accn")).alias("b"))
        .withColumn("_rank", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("end")))).where(F.col("_rank") <= years)
        .select("symbol", "b.start", "end", "b.filed", "b.accn")
    )
    return annual.join(aligned, ["symbol", "start", "end"]).select(
        "symbol", F.col("start").alias("period_start"), F.col("end").alias("period_end"), F.col("filed").alias("filed_at"),
        F.col("accn").alias("accession"), *HISTORY_METRICS,
        S.free_cash_flow(F.col("operating_cash_flow"), F.col("capex")).alias("free_cash_flow"),
    )


def annual_summary(history: DataFrame) -> DataFrame:
    """Five-year growth and counts of positive years; growth needs six contiguous endpoints, both ends positive."""
    order = W.partitionBy("symbol").orderBy("period_end")
    newest = W.partitionBy("symbol").orderBy(F.desc("period_end"))
    step = F.datediff("period_end", F.lag("period_end").over(order))
    rows = (
        history.withColumn("_rank", F.row_number().over(newest)).where("_rank <= 6")
        .withColumn("_joined", F.coalesce(step.between(330, 400), F.lit(True)))
    )
    recent = F.col("_rank") <= 5
    agg = rows.groupBy("symbol").agg(
        F.count("*").alias("n"), F.bool_and("_joined").alias("history_contiguous"),
        F.min_by(F.struct("period_end", "revenue"), "period_end").alias("a"),
        F.max_by(F.struct("period_end", "revenue"), "period_end").alias("b"),
        F.count(F.when(recent, F.col("free_cash_flow"))).alias("cash_years_known"),
        F.count_if(recent & (F.col("free_cash_flow") > 0)).alias("cash_years_positive"),
        F.count(F.when(recent, F.col("net_income"))).alias("profit_years_known"),
        F.count_if(recent & (F.col("net_income") > 0)).alias("profit_years_positive"),
    )
    elapsed = F.datediff("b.period_end", "a.period_end") / F.lit(365.25)
    usable = (F.col("n") == 6) & F.col("history_contiguous") & (F.col("a.revenue") > 0) & (F.col("b.revenue") > 0)
    growth = F.lit(100.0) * (F.pow(F.col("b.revenue") / F.col("a.revenue"), F.lit(1.0) / elapsed) - F.lit(1.0))
    return agg.select(
        "symbol", "history_contiguous", F.when(usable, growth).alias("revenue_cagr5y"),
        "cash_years_known", "cash_years_positive", "profit_years_known", "profit_years_positive",
    )


def return_on_equity(income: Column, equity: Column, prior_equity: Column) -> Column:
    return F.when(
        income.isNotNull() & (F.least(equity, prior_equity) > 0) & equity.isNotNull() & prior_equity.isNotNull(),
        F.lit(100.0) * income / ((equity + prior_equity) / 2),
    )


def debt_to_cash_flow(current: Column, noncurrent: Column, cash_flow: Column) -> Column:
    return F.when(cash_flow > 0, (current + noncurrent) / cash_flow)


def diluted_shares(periods: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Direct quarter at the snapshot end, never derived; for a quarterly snapshot else the matching annual one."""
    shares = periods.where("metric = 'diluted_shares'")
    at = snapshots.select("symbol", "period_end", "period_type")
    direct = standalone_quarters(shares).where("NOT derived").select("symbol", "start", "end", "val", F.lit(0).alias("rank"))
    annual = shares.where(S.annual_span(F.datediff("end", "start"))).select("symbol", "start", "end", "val", F.lit(1).alias("rank"))
    rows = direct.unionByName(annual).join(at, "symbol").where(
        (F.col("end") == F.col("period_end")) & ((F.col("rank") == 0) | (F.col("period_type") == "quarter")))
    best = rows.groupBy("symbol", "period_end").agg(F.max_by(F.struct("start", "val"), F.struct(-F.col("rank"), F.col("start"))).alias("s"))
    return best.select(
        "symbol", F.col("s.val").alias("diluted_shares"), F.col("s.start").alias("shares_start"),
        F.concat_ws(" / ", F.col("s.start").cast("string"), F.col("period_end").cast("string")).alias("shares_period"))


def balance_evidence(instants: DataFrame) -> DataFrame:
    """Per symbol a map from item to its value, end, filing and tag; at most one entry per item of the vocabulary."""
    entry = F.struct("metric", F.struct("val", "end", "filed", "accn", "concept").alias("evidence"))
    return instants.groupBy("symbol").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("balance_evidence"))


def prior_equity_ends(facts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Latest equity date about a year before each snapshot end."""
    equity = facts.where(
        F.col("concept").isin(*INSTANT_CONCEPTS["equity"]) & (F.col("unit") == "USD") & taxonomy_rank("taxonomy").isNotNull()
    ).select("symbol", "end").distinct()
    near = equity.join(snapshots.select("symbol", "period_end"), "symbol").where(
        F.abs(F.datediff("period_end", "end") - 365) <= 14)
    return near.groupBy("symbol").agg(F.max("end").alias("end"))


def financial_quality(facts: DataFrame, concepts: DataFrame, snapshots: DataFrame, as_of) -> DataFrame:
    """One wide row per snapshot: history summary, equity, debt, shares and the cash proxy; missing is never zero."""
    as_of = as_date(as_of)
    obs = observations(facts, concepts)
    wanted = (*HISTORY_METRICS, "diluted_shares")
    return quality_of(
        periods_as_of(obs.where(F.col("metric").isin(*wanted)), as_of), instant_rows(facts, concepts), snapshots, as_of)


def quality_of(periods: DataFrame, instants: DataFrame, snapshots: DataFrame, as_of, tasks: int | None = None) -> DataFrame:
    """`financial_quality` from resolved periods and balance rows; every join is on the symbol alone. `tasks`: how many tasks the
    rows are dealt to, where the caller knows the size of the input."""
    periods = dealt(periods, tasks, "symbol") if tasks else periods.repartition("symbol")
    summary = annual_summary(annual_history(periods))
    ends = snapshots.select("symbol", F.col("period_end").alias("end"))
    balance = (
        instant_facts(instants, ends, as_of, tasks).groupBy("symbol").pivot("metric", list(INSTANT_CONCEPTS)).agg(F.first("val"))
    )
    equity = instants.where("metric = 'equity'")
    prior = instant_facts(equity, prior_equity_ends(equity, snapshots), as_of, tasks).select(
        "symbol", F.col("val").alias("prior_equity"))
    compensation = trailing_year(periods.where("metric = 'share_compensation'")).select(
        "symbol", F.col("end").alias("_sbc_end"), F.col("val").alias("_sbc"))
    shares = diluted_shares(periods, snapshots)
    wide = (
        snapshots.join(summary, "symbol", "left").join(balance, "symbol", "left").join(prior, "symbol", "left")
        .join(compensation, "symbol", "left").join(shares, "symbol", "left")
        .withColumn("share_compensation_ttm", F.when(F.col("_sbc_end") == F.col("period_end"), F.col("_sbc")))
    )
    proxy = F.when(
        F.col("diluted_shares") > 0,
        (F.col("free_cash_flow_ttm") - F.col("share_compensation_ttm")) / F.col("diluted_shares"))
    return wide.select(
        "symbol", F.lit(QUALITY_VERSION).alias("version"), "currency", "period_end",
        F.coalesce("history_contiguous", F.lit(True)).alias("history_contiguous"), "revenue_cagr5y",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cash_years_known", "cash_years_positive", "profit_years_known", "profit_years_positive")],
        return_on_equity(F.col("net_income_ttm"), F.col("equity"), F.col("prior_equity")).alias("roe_ttm"),
        "equity", (F.col("current_long_debt") + F.col("noncurrent_long_debt")).alias("long_debt"),
        debt_to_cash_flow(F.col("current_long_debt"), F.col("noncurrent_long_debt"), F.col("operating_cash_flow_ttm")).alias("long_debt_to_ocf"),
        "cash", "short_borrowings", "commercial_paper", "share_compensation_ttm", "diluted_shares", "shares_period",
        proxy.alias("cash_per_share_proxy"),
    )
