"""Scenario arithmetic as column expressions; grids are small literal arrays exploded per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.schemas import ALGORITHM_VERSION, QUALITY_VERSION, SNAPSHOT_VERSION

STALE_DAYS = 160


def discounted_cash_value(df: DataFrame, price: str = "price") -> DataFrame:
    """Present value of yearly cash plus a Gordon terminal value; null throughout when an assumption is out of range.

    Columns: cash_per_share, growth, required_return, terminal_growth, safety_margin, years (all in percent or years).
    """
    cash, growth, need = F.col("cash_per_share"), F.col("growth"), F.col("required_return")
    terminal, margin, years = F.col("terminal_growth"), F.col("safety_margin"), F.col("years")
    inputs = (cash, growth, need, terminal, margin, years)
    finite = S.finite(inputs[0])
    for value in inputs[1:]:
        finite = finite & S.finite(value)
    usable = (
        finite & (cash > 0) & (growth > -100) & (need > 0) & (terminal > -100) & (need > terminal)
        & (margin >= 0) & (margin < 100) & (years == F.floor(years)) & (years >= 1) & (years <= 20)
    )
    up, down, drift = growth / 100, need / 100, terminal / 100

    def flow(year: Column) -> Column:
        year = year.cast("double")
        return cash * F.pow(up + 1, year) / F.pow(down + 1, year)

    horizon = F.when(usable, years.cast("int"))
    present = F.aggregate(F.sequence(F.lit(1), horizon), F.lit(0.0), lambda total, year: total + flow(year))
    last = cash * F.pow(up + 1, horizon.cast("double"))
    terminal_value = last * (drift + 1) / (down - drift) / F.pow(down + 1, horizon.cast("double"))
    rows = df.withColumns({"present_cash": F.when(usable, present), "present_terminal": F.when(usable, terminal_value)})
    total = F.col("present_cash") + F.col("present_terminal")
    value = F.when(S.finite(total) & (total > 0), total)
    keep = F.col("value").isNotNull()
    quoted = F.col(price)
    return rows.withColumn("value", value).withColumns({
        "entry_price": F.col("value") * (F.lit(1.0) - margin / 100),
        "margin_at_price": F.when(S.finite(quoted) & (quoted > 0), (F.lit(1.0) - quoted / F.col("value")) * 100),
        "terminal_weight": F.col("present_terminal") / F.col("value") * 100,
        "present_cash": F.when(keep, F.col("present_cash")), "present_terminal": F.when(keep, F.col("present_terminal")),
    })


def offset_grid(df: DataFrame, growth_offsets=(-3, 0, 3), return_offsets=(-1, 0, 1)) -> DataFrame:
    """Every row with each growth and return offset applied (nine rows by default)."""
    cells = F.array(*[
        F.struct(F.lit(float(g)).alias("growth_offset"), F.lit(float(r)).alias("return_offset"))
        for g in growth_offsets for r in return_offsets
    ])
    return df.select("*", F.inline(cells)).withColumns({
        "growth": F.col("growth") + F.col("growth_offset"), "required_return": F.col("required_return") + F.col("return_offset")})


def sensitivity_grid(df: DataFrame, price: str = "price") -> DataFrame:
    return discounted_cash_value(offset_grid(df), price)


def project_revenue_price(df: DataFrame) -> DataFrame:
    """Revenue to price: growth, margin, multiple, diluted shares; USD only, one or two years."""
    c = F.col
    two = c("years") == 2
    usable = c("currency") == "USD"
    for name in ("annual_revenue", "net_margin", "target_pe", "diluted_shares", "first_growth", "annual_share_change", "years"):
        usable = usable & S.finite(c(name))
    usable = (
        usable & (~two | S.finite(c("second_growth"))) & (c("annual_revenue") > 0) & (c("net_margin") > 0)
        & (c("net_margin") <= 100) & (c("target_pe") > 0) & (c("diluted_shares") > 0) & (c("first_growth") > -100)
        & (~two | (c("second_growth") > -100)) & (c("annual_share_change") > -100) & c("years").isin(1, 2)
    )
    usable = F.coalesce(usable, F.lit(False))
    factor = (c("first_growth") / 100 + 1) * F.when(two, c("second_growth") / 100 + 1).otherwise(F.lit(1.0))
    rows = df.withColumn("projected_revenue", F.when(usable, c("annual_revenue") * factor))
    rows = rows.withColumn("projected_profit", c("projected_revenue") * c("net_margin") / 100)
    dilution = c("annual_share_change") / 100 + 1
    rows = rows.withColumn("projected_shares", F.when(usable, c("diluted_shares") * F.when(two, dilution * dilution).otherwise(dilution)))
    rows = rows.withColumn("projected_eps", c("projected_profit") / c("projected_shares"))
    rows = rows.withColumn("projected_market_cap", c("projected_profit") * c("target_pe"))
    return rows.withColumn("target_price", c("projected_market_cap") / c("projected_shares"))


def fresh_snapshot(as_of: Column, pending: Column) -> Column:
    """Current schema, a period end within 160 days, nothing newer pending."""
    age = F.datediff(as_of, F.col("period_end"))
    return F.coalesce((F.col("schema_version") == SNAPSHOT_VERSION) & age.between(0, STALE_DAYS) & ~pending, F.lit(False))


def projection_baseline(companies: DataFrame, as_of: Column) -> DataFrame:
    """Annual revenue, net margin and shares to start a projection from; null wherever evidence is missing.

    `companies` holds one row per symbol: snapshot columns, `pending`, and quality columns prefixed `q_`.
    """
    c = F.col
    fresh = fresh_snapshot(as_of, F.coalesce(c("pending"), F.lit(False)))
    own = c("period_type").isin("quarter", "annual")
    annual = (
        F.when((c("period_type") == "quarter") & (c("revenue") > 0), c("revenue") * 4)
        .when((c("period_type") == "annual") & (c("revenue") > 0), c("revenue"))
        .when(c("revenue_ttm") > 0, c("revenue_ttm"))
    )
    income = F.when(own, c("net_income")).otherwise(c("net_income_ttm"))
    operating = F.when(own, c("operating_income")).otherwise(c("operating_income_ttm"))
    revenue = F.when(own, c("revenue")).otherwise(c("revenue_ttm"))
    rows = companies.withColumn("annual_revenue", F.when(fresh & (c("currency") == "USD"), annual))
    usable = (
        c("annual_revenue").isNotNull() & (income > 0) & (operating > 0) & (revenue > 0)
        & (income <= operating * 1.5) & (income <= revenue)
    )
    shares = fresh & (c("q_version") == QUALITY_VERSION) & (c("q_currency") == "USD") & (c("q_period_end") == c("period_end")) & (c("q_diluted_shares") > 0)
    return rows.select(
        "symbol", "annual_revenue", F.when(usable, income / revenue * 100).alias("net_margin"),
        F.when(shares, c("q_diluted_shares")).alias("diluted_shares"),
        F.when(c("currency") == "TWD", "native_currency").when(~fresh, "not_fresh")
        .when(~F.coalesce(usable, F.lit(False)), "margin_unusable").when(~F.coalesce(shares, F.lit(False)), "shares_missing").alias("warning"),
    )


def cash_baseline(companies: DataFrame, as_of: Column) -> DataFrame:
    """Cash per share to start a valuation from, when snapshot, quality and valuation agree and are current."""
    c = F.col
    agree = (
        (c("schema_version") == SNAPSHOT_VERSION) & (c("currency") == "USD") & (c("q_version") == QUALITY_VERSION)
        & (c("q_currency") == "USD") & (c("q_period_end") == c("period_end")) & ~F.coalesce(c("pending"), F.lit(False))
        & (c("algorithm_version") == ALGORITHM_VERSION) & c("current_pe_qualified") & (c("eps_period_end") == c("period_end"))
        & F.datediff(as_of, c("q_period_end")).between(0, STALE_DAYS)
        & S.finite(c("q_cash_per_share_proxy")) & (c("q_cash_per_share_proxy") > 0)
    )
    return companies.select("symbol", F.when(agree, c("q_cash_per_share_proxy")).alias("cash_per_share"))


def js_round(value: Column, digits: int = 0) -> Column:
    """Half toward plus infinity."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def scenario_presets(outlook: DataFrame) -> DataFrame:
    """Base, conservative and optimistic versions of (first_growth, second_growth, terminal_pe)."""
    # Preset, factors for the two growth steps and the multiple, floors.
    presets = (("base", None, None), ("conservative", (0.72, 0.68, 0.85), (0.0, 0.0, 8.0)), ("optimistic", (1.18, 1.25, 1.18), None))
    names = ("first_growth", "second_growth", "terminal_pe")
    rows = []
    for preset, factors, floors in presets:
        values = [F.col(n).cast("double") for n in names]
        if factors:
            values = [js_round(v * F.lit(f)) for v, f in zip(values, factors)]
        if floors:
            values = [F.greatest(v, F.lit(f)) for v, f in zip(values, floors)]
        rows.append(F.struct(F.lit(preset).alias("preset"), *[v.alias(n) for v, n in zip(values, names)]))
    return outlook.select(*[c for c in outlook.columns if c not in names], F.inline(F.array(*rows)))


def profit_outlook(df: DataFrame) -> DataFrame:
    """Two growth steps of a quarterly profit (billions), annualised, times the multiple, in trillions."""
    first = js_round(F.col("base_profit") * (F.col("first_growth") / 100 + 1), 1)
    rows = df.withColumn("first_profit", first)
    rows = rows.withColumn("second_profit", js_round(F.col("first_profit") * (F.col("second_growth") / 100 + 1), 1))
    rows = rows.withColumn("annual_profit", F.col("second_profit") * 4)
    return rows.withColumn("target_market_cap", F.col("annual_profit") * F.col("terminal_pe") / 1000)


def margin_verdict(price_ready: Column, value: Column, reviewed: Column, margin: Column, safety: Column) -> Column:
    return (
        F.when(~F.coalesce(price_ready, F.lit(False)), "price_not_ready").when(value.isNull(), "no_result")
        .when(~F.coalesce(reviewed, F.lit(False)), "unreviewed").when(margin >= safety, "has_margin").otherwise("below_margin")
    )


def relative_to_close(target: Column, close: Column) -> Column:
    """Target over close minus one, in percent; null when either side is missing."""
    return F.when(close > 0, (target / close - 1) * 100)


def frozen_scenario(companies: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Published scenarios applied to their own symbol only, beside the live baseline (`shares` come from the live side)."""
    return companies.join(scenarios, "symbol").select(
        "symbol", "published_at", (F.col("quarter_revenue") * 4).alias("annual_revenue"),
        (F.col("quarter_profit") / F.col("quarter_revenue") * 100).alias("net_margin"), "diluted_shares",
        "first_growth", "second_growth", "target_pe",
    )
