"""Assessment of a company row: metrics with a state, an overall state, and verdict codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators.scenarios import fresh_snapshot
from plumbline.operators.valuation import eligible_percentile
from plumbline.schemas import ALGORITHM_VERSION, QUALITY_VERSION

OPEN_QUESTIONS = ("full_debt_and_allocation", "competitive_advantage", "sustainable_cash_and_margin")
LONG_RECORD = ("cagr", "consistency", "roe", "debt")


def abnormal_profit() -> Column:
    """Net income above 1.5 times positive operating income, or positive beside an operating loss."""
    income, operating = F.col("net_income"), F.col("operating_income")
    odd = F.when(operating <= 0, income > 0).otherwise(income > operating * 1.5)
    return F.coalesce(S.finite(income) & S.finite(operating) & odd, F.lit(False))


def valid_multiple() -> Column:
    pe = F.col("pe")
    ok = (F.col("algorithm_version") == ALGORITHM_VERSION) & F.col("current_pe_qualified") & S.finite(pe) & (pe > 0)
    return F.coalesce(ok, F.lit(False))


def is_fresh(as_of: Column) -> Column:
    return fresh_snapshot(as_of, F.coalesce(F.col("pending"), F.lit(False)))


def assess_metrics(companies: DataFrame, as_of: Column) -> DataFrame:
    """Long table (symbol, metric, value, unit, state) of ten standing metrics plus the profit check when it applies.

    `companies` has one row per symbol: snapshot, valuation and `q_` quality columns, and `pending`.
    """
    c = F.col
    rows = companies.withColumns({"fresh": is_fresh(as_of), "abnormal": abnormal_profit(), "pe_valid": valid_multiple()})
    quality = (c("q_version") == QUALITY_VERSION) & (c("q_period_end") == c("period_end"))
    cash_years = F.when(quality & (c("q_cash_years_known") == 5) & c("q_history_contiguous"), c("q_cash_years_positive").cast("double"))
    roe, debt, cagr = (F.when(quality, c(f"q_{n}")) for n in ("roe_ttm", "long_debt_to_ocf", "revenue_cagr5y"))

    def metric(key: str, value: Column, unit: str, support, fixed_state: Column | None = None) -> Column:
        value = S.finite_or_null(value)
        state = F.when(~c("fresh") | value.isNull(), "unknown").when(support(value), "support").otherwise("caution")
        return F.struct(
            F.lit(key).alias("metric"), value.alias("value"), F.lit(unit).alias("unit"),
            (state if fixed_state is None else fixed_state).alias("state"))

    items = [
        metric("growth", c("revenue_yoy"), "%", lambda v: v > 0),
        metric("margin", S.positive_ratio(c("operating_income"), c("revenue")), "%", lambda v: v >= 15),
        metric("conversion", S.positive_ratio(c("operating_cash_flow"), c("net_income")), "%", lambda v: v >= 100),
        metric("cash", S.positive_ratio(c("free_cash_flow"), c("revenue")), "%", lambda v: v > 0),
        metric("reinvestment", S.positive_ratio(c("capex"), c("operating_cash_flow")), "%", lambda v: v <= 100),
        metric("yield", F.when(c("pe_valid"), F.lit(100.0) / c("pe")), "%", lambda v: v > 0, F.lit("unknown")),
        F.when(c("fresh") & c("abnormal"), metric(
            "profit_quality", S.positive_ratio(c("net_income"), c("operating_income"), 1.0), "x", lambda v: v < 0, F.lit("caution"))),
        metric("cagr", cagr, "%", lambda v: v > 0),
        metric("consistency", cash_years, "years", lambda v: v == 5),
        metric("roe", roe, "%", lambda v: v.between(15, 80) & ~c("abnormal")),
        metric("debt", debt, "x", lambda v: v < 0, F.when(
            c("fresh") & S.finite(debt) & (debt > 3), "caution").otherwise("unknown")),
    ]
    listed = F.filter(F.array(*items), lambda item: item.isNotNull())
    return rows.select("symbol", "fresh", "pe_valid", F.inline(listed))


def assessment_state(metrics: DataFrame) -> DataFrame:
    """incomplete (not fresh or no multiple), caution (any concern), incomplete (long record missing), else research."""
    missing_record = F.col("metric").isin(*LONG_RECORD) & F.col("value").isNull()
    rows = metrics.groupBy("symbol").agg(
        F.bool_and("fresh").alias("fresh"), F.bool_and("pe_valid").alias("pe_valid"),
        F.count_if(F.col("state") == "support").alias("supports"), F.count_if(F.col("state") == "caution").alias("concerns"),
        F.count_if(missing_record).alias("record_gaps"),
    )
    state = (
        F.when(~F.col("fresh") | ~F.col("pe_valid"), "incomplete").when(F.col("concerns") > 0, "caution")
        .when(F.col("record_gaps") > 0, "incomplete").otherwise("research")
    )
    return rows.withColumn("state", state)


def missing_evidence(metrics: DataFrame) -> DataFrame:
    """Per symbol the ordered list of what is missing; eleven metrics and the open questions bound its length."""
    order = ("growth", "margin", "conversion", "cash", "reinvestment", "profit_quality", *LONG_RECORD)
    position = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("metric"))
    gap = F.when(F.col("value").isNull() & (F.col("metric") != "yield"), F.struct(position.alias("at"), "metric"))
    rows = metrics.groupBy("symbol").agg(
        F.bool_and("fresh").alias("fresh"), F.bool_and("pe_valid").alias("pe_valid"), F.sort_array(F.collect_list(gap)).alias("gaps"))
    head = F.array_compact(F.array(
        F.when(~F.col("fresh"), F.lit("current_report")), F.when(~F.col("pe_valid"), F.lit("current_multiple"))))
    names = F.transform("gaps", lambda g: g["metric"])
    return rows.select("symbol", F.concat(head, names, F.array(*[F.lit(q) for q in OPEN_QUESTIONS])).alias("missing"))


def price_verdict(companies: DataFrame, as_of: Column, connected: Column) -> DataFrame:
    """Cheap, middle or expensive against the own history, or why that cannot be said."""
    percentile, years = eligible_percentile(), F.col("horizon_years")
    ready = F.coalesce(
        connected & is_fresh(as_of) & percentile.between(0, 100) & years.isNotNull() & (years > 0), F.lit(False))
    label = (
        F.when(~ready, "unknown").when(abnormal_profit(), F.when(percentile <= 20, "low_multiple_check").otherwise("profit_check"))
        .when(percentile <= 20, "cheap").when(percentile >= 80, "expensive").otherwise("middle")
    )
    reason = (
        F.when(~ready, F.when(~connected, "disconnected").otherwise("not_ready")).when(abnormal_profit(), "abnormal_profit")
        .when(F.col("free_cash_flow") < 0, "negative_free_cash").when(F.col("fcf_delta") < 0, "declining_free_cash").otherwise("own_history_only")
    )
    tone = (
        F.when(~ready, "neutral").when(abnormal_profit(), "watch").when(percentile <= 20, "positive")
        .when(percentile >= 80, "watch").otherwise("neutral")
    )
    return companies.select("symbol", label.alias("label"), reason.alias("reason"), tone.alias("tone"), F.when(ready, percentile).alias("percentile"))


def late_or_abnormal(as_of: Column) -> tuple[Column, Column, Column]:
    """(non-operating effect, stale period, pending report) flags of the merge rules."""
    income, operating = F.col("net_income"), F.col("operating_income")
    effect = F.coalesce((operating > 0) & (income > operating * 1.5), F.lit(False))
    stale = F.coalesce(F.datediff(as_of, "period_end") > 160, F.lit(False))
    return effect, stale, F.coalesce(F.col("pending"), F.lit(False))


def stance_codes(companies: DataFrame, as_of: Column) -> DataFrame:
    """Stance, tone and warning codes; later rules win over earlier ones."""
    percentile = eligible_percentile()
    effect, stale, pending = late_or_abnormal(as_of)
    no_finance = F.coalesce(F.col("schema_version") != 3, F.lit(True)) | F.col("period_end").isNull()
    check = effect | stale | pending
    band = F.when(percentile.isNull(), "undetermined").when(percentile <= 20, "low").when(percentile >= 80, "high").otherwise("middle")
    tone = F.when(percentile <= 20, "positive").when(percentile >= 80, "watch").otherwise("neutral")
    warning = (
        F.when(no_finance, "finance_unverified").when(effect, "non_operating_profit").when(pending | stale, "finance_late")
        .when(F.col("free_cash_flow") < 0, "negative_free_cash").when(F.col("fcf_delta") < 0, "declining_free_cash").otherwise("keep_checking")
    )
    return companies.select(
        "symbol", F.when(no_finance, "finance_check").when(check, "profit_check").otherwise(band).alias("stance"),
        F.when(no_finance, "neutral").when(check, "watch").otherwise(tone).alias("tone"), warning.alias("warning"),
    )


def cash_proof_status(companies: DataFrame) -> DataFrame:
    """Negative free cash beats the sign of its change."""
    flow, delta = F.col("free_cash_flow"), F.col("fcf_delta")
    status = (
        F.when(flow < 0, "negative").when(delta.isNull(), "level_only").when(delta > 0, "improving")
        .when(delta < 0, "declining").otherwise("flat")
    )
    tone = F.when(flow < 0, "watch").when(delta.isNull() | (delta == 0), "neutral").when(delta > 0, "positive").otherwise("watch")
    return companies.select("symbol", status.alias("status"), tone.alias("tone"), S.finite_or_null(F.col("marginal_coverage")).alias("marginal_coverage"))


def compare(metrics: DataFrame, view: str = "all", sort: str = "symbol", ascending: bool = True, drafts: DataFrame | None = None) -> DataFrame:
    """Screen and sort: `all`, `cash` (positive free cash margin) or `history` (five positive years); nulls always last.

    With `drafts` (symbol, candidate) only symbols marked as candidates come, in any of the views.
    """
    if drafts is not None:
        metrics = metrics.join(drafts.where("candidate").select("symbol").distinct(), "symbol", "left_semi")
    keys = ["cagr", "margin", "cash", "roe", "consistency"]
    wide = metrics.groupBy("symbol").pivot("metric", keys).agg(F.first("value"))
    fresh = metrics.groupBy("symbol").agg(F.bool_and("fresh").alias("fresh"))
    rows = wide.join(fresh, "symbol")
    if view == "cash":
        rows = rows.where(F.col("fresh") & (F.coalesce("cash", F.lit(-1.0)) > 0))
    elif view == "history":
        rows = rows.where(F.col("fresh") & (F.col("consistency") == 5))
    key = F.col(sort)
    return rows.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last(), "symbol")


def suspend_judgments(valuation: DataFrame, connected: Column) -> DataFrame:
    """While disconnected, dated values stay and ranks go."""
    off = ~connected
    return valuation.withColumns({
        "status": F.when(off, "stale").otherwise(F.col("status")),
        "current_pe_qualified": ~off & F.col("current_pe_qualified"),
        "percentile": F.when(~off, F.col("percentile")), "percentile10y": F.when(~off, F.col("percentile10y")),
    })


def outlook_baseline(companies: DataFrame, as_of: Column) -> DataFrame:
    """Quarterly profit in billions to project from, or the code of what blocks it."""
    effect, stale, pending = late_or_abnormal(as_of)
    usable = (
        (F.col("currency") == "USD") & (F.col("period_type") == "quarter") & (F.col("net_income") > 0)
        & ~effect & ~stale & ~pending
    )
    usable = F.coalesce(usable, F.lit(False))
    blocked = F.when(F.col("currency") != "USD", "native_currency").when(effect, "non_operating_profit").when(~usable, "no_current_quarter")
    return companies.select("symbol", F.when(usable, F.col("net_income") / 1e9).alias("base_profit"), blocked.alias("blocked"))
