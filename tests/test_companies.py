from __future__ import annotations

import pytest
from conftest import d, only
from pyspark.sql import functions as F

from plumbline.operators import assess, filings, fundamentals, quotes, scenarios
from plumbline.functions import scalars as S

ASSUMPTIONS = "cash_per_share double, growth double, required_return double, terminal_growth double, safety_margin double, years double, price double"


def dcf(spark, *values):
    return only(scenarios.discounted_cash_value(spark.createDataFrame([tuple(None if v is None else float(v) for v in values)], ASSUMPTIONS)))


def test_level_perpetuity(spark):
    row = dcf(spark, 10, 0, 10, 0, 25, 10, 80)
    assert row["value"] == pytest.approx(100) and row["entry_price"] == pytest.approx(75) and row["margin_at_price"] == pytest.approx(20)


@pytest.mark.parametrize("values", [
    (10, 5, 10, 10, 25, 10, 80), (-1, 5, 10, 2, 25, 10, 80), (10, float("nan"), 10, 2, 25, 10, 80), (10, 5, 10, 2, 100, 10, 80), (10, 5, 10, 2, 25, 10.5, 80),
    (10, 5, 10, 2, 25, 21, 80), (10, -100, 10, 2, 25, 10, 80), (None, 5, 10, 2, 25, 10, 80)])
def test_invalid_assumptions_have_no_value(spark, values):
    row = dcf(spark, *values)
    assert row["value"] is None and row["present_cash"] is None


def test_missing_price_leaves_the_value(spark):
    row = dcf(spark, 10, 5, 10, 2, 25, 10, None)
    assert row["value"] is not None and row["margin_at_price"] is None
    assert dcf(spark, 10, 5, 12, 2, 25, 10, 80)["value"] < row["value"]


PROJECTION = ("annual_revenue double, currency string, net_margin double, target_pe double, diluted_shares double, first_growth double, second_growth double, "
              "annual_share_change double, years int")
BASE = {"annual_revenue": 400.0, "currency": "USD", "net_margin": 20.0, "target_pe": 20.0, "diluted_shares": 40.0, "first_growth": 10.0, "second_growth": 20.0,
        "annual_share_change": 0.0, "years": 2}


def project(spark, **changes):
    values = {**BASE, **changes}
    return only(scenarios.project_revenue_price(spark.createDataFrame([tuple(values[k.split()[0]] for k in PROJECTION.split(", "))], PROJECTION)))["target_price"]


def test_projected_price_and_its_guards(spark):
    assert project(spark) == pytest.approx(52.8)
    assert project(spark, years=1) == pytest.approx(44)
    assert project(spark, years=1, second_growth=None) == pytest.approx(44)
    assert project(spark, annual_share_change=10.0) == pytest.approx(52.8 / 1.21)
    for bad in ({"currency": "TWD"}, {"net_margin": 0.0}, {"net_margin": 101.0}, {"diluted_shares": 0.0}, {"first_growth": -100.0}, {"years": 3}, {"second_growth": None}):
        assert project(spark, **bad) is None


def test_presets_round_half_up_and_keep_floors(spark):
    df = spark.createDataFrame([("X", 0.0, 10.0, 5.0)], "symbol string, first_growth double, second_growth double, terminal_pe double")
    rows = {r["preset"]: r for r in scenarios.scenario_presets(df).collect()}
    assert (rows["conservative"]["terminal_pe"], rows["conservative"]["second_growth"], rows["optimistic"]["second_growth"]) == (8, 7, 13)


COMPANY = {
    "symbol": ("string", "X"), "schema_version": ("int", 3), "currency": ("string", "USD"), "period_type": ("string", "quarter"),
    "period_end": ("date", d("2026-06-30")), "revenue": ("double", 100.0), "revenue_yoy": ("double", 10.0), "operating_income": ("double", 25.0),
    "net_income": ("double", 20.0), "operating_cash_flow": ("double", 30.0), "capex": ("double", 10.0), "free_cash_flow": ("double", 20.0),
    "fcf_delta": ("double", 1.0), "marginal_coverage": ("double", None), "revenue_ttm": ("double", None), "net_income_ttm": ("double", None),
    "operating_income_ttm": ("double", None), "algorithm_version": ("int", 4), "current_pe_qualified": ("boolean", True), "status": ("string", "qualified"),
    "frequency": ("string", "daily"), "pe": ("double", 10.0), "percentile": ("double", 1.0), "horizon_years": ("int", 10),
    "eps_period_end": ("date", d("2026-06-30")), "q_version": ("int", None), "q_currency": ("string", None), "q_period_end": ("date", d("2026-06-30")),
    "q_history_contiguous": ("boolean", True), "q_revenue_cagr5y": ("double", 10.0), "q_cash_years_known": ("int", 5), "q_cash_years_positive": ("int", 5),
    "q_roe_ttm": ("double", 20.0), "q_long_debt_to_ocf": ("double", 1.0), "q_diluted_shares": ("double", None), "q_cash_per_share_proxy": ("double", 10.0),
    "pending": ("boolean", False),
}


def company(spark, **changes):
    schema = ", ".join(f"{name} {kind}" for name, (kind, _) in COMPANY.items())
    return spark.createDataFrame([tuple(changes.get(name, value) for name, (_, value) in COMPANY.items())], schema)


def now():
    return F.lit("2026-09-09").cast("date")


def assessed(spark, **changes):
    metrics = assess.assess_metrics(company(spark, **changes), now())
    return only(assess.assessment_state(metrics)), {r["metric"]: r for r in metrics.collect()}


def test_low_multiple_does_not_cancel_concerns(spark):
    state, metrics = assessed(spark, net_income=80.0, free_cash_flow=-10.0, capex=40.0)
    assert state["state"] == "caution" and metrics["cash"]["state"] == "caution" and metrics["profit_quality"]["state"] == "caution"


def test_missing_stale_or_pending_evidence_supports_nothing(spark):
    for changes in ({"period_end": None}, {"period_end": d("2024-06-30")}, {"pending": True}):
        state, _ = assessed(spark, **changes)
        assert (state["state"], state["supports"]) == ("incomplete", 0)


def test_healthy_metrics_are_research_only_with_a_long_record(spark):
    assert assessed(spark)[0]["state"] == "incomplete"
    state, metrics = assessed(spark, q_version=1)
    assert state["state"] == "research" and metrics["debt"]["state"] == "unknown" and metrics["yield"]["state"] == "unknown"
    assert assessed(spark, q_version=1, q_long_debt_to_ocf=3.5)[0]["state"] == "caution"
    assert assessed(spark, q_version=1, q_roe_ttm=90.0)[1]["roe"]["state"] == "caution"


def test_ratios_do_not_depend_on_currency(spark):
    _, metrics = assessed(spark, currency="TWD")
    assert (metrics["margin"]["value"], metrics["cash"]["value"]) == (25, 20)


def test_missing_evidence_is_listed_in_order(spark):
    metrics = assess.assess_metrics(company(spark, revenue_yoy=None, pe=None), now())
    assert only(assess.missing_evidence(metrics))["missing"] == [
        "current_multiple", "growth", "cagr", "consistency", "roe", "debt", "full_debt_and_allocation", "competitive_advantage", "sustainable_cash_and_margin"]


def test_cash_baseline_needs_agreement(spark):
    good = {"q_version": 1, "q_currency": "USD"}
    assert only(scenarios.cash_baseline(company(spark, **good), now()))["cash_per_share"] == 10
    for bad in ({"q_currency": "TWD"}, {"q_cash_per_share_proxy": -2.0}, {"eps_period_end": d("2026-03-31")}, {"pending": True}):
        assert only(scenarios.cash_baseline(company(spark, **{**good, **bad}), now()))["cash_per_share"] is None


def test_projection_baseline(spark):
    row = only(scenarios.projection_baseline(company(spark), now()))
    assert (row["annual_revenue"], row["net_margin"], row["diluted_shares"], row["warning"]) == (400, 20, None, "shares_missing")
    assert only(scenarios.projection_baseline(company(spark, period_type="annual"), now()))["annual_revenue"] == 100
    assert only(scenarios.projection_baseline(company(spark, net_income=80.0), now()))["net_margin"] is None
    assert only(scenarios.projection_baseline(company(spark, currency="TWD"), now()))["annual_revenue"] is None
    assert only(scenarios.projection_baseline(company(spark, period_end=d("2024-06-30")), now()))["annual_revenue"] is None


def verdict(spark, connected=True, **changes):
    return only(assess.price_verdict(company(spark, **changes), now(), F.lit(connected)))


def test_price_verdicts(spark):
    assert [verdict(spark, percentile=p)["label"] for p in (1.0, 50.0, 90.0)] == ["cheap", "middle", "expensive"]
    assert verdict(spark, connected=False)["label"] == "unknown"
    assert verdict(spark, period_end=d("2024-06-30"))["label"] == "unknown"
    odd = verdict(spark, net_income=80.0)
    assert (odd["label"], odd["tone"]) == ("low_multiple_check", "watch")
    assert verdict(spark, frequency="annual")["label"] == "unknown"


def test_zero_percentile_counts_and_stances(spark):
    assert only(assess.stance_codes(company(spark, percentile=0.0), now()))["stance"] == "low"
    assert only(assess.stance_codes(company(spark, percentile=None), now()))["stance"] == "undetermined"
    assert only(assess.stance_codes(company(spark, net_income=80.0), now()))["stance"] == "profit_check"
    assert only(assess.stance_codes(company(spark, schema_version=2), now()))["stance"] == "finance_check"


def test_negative_cash_beats_its_improvement(spark):
    assert only(assess.cash_proof_status(company(spark, free_cash_flow=-8.0, fcf_delta=9.0)))["status"] == "negative"


def test_outlook_blocks(spark):
    assert only(assess.outlook_baseline(company(spark), now()))["base_profit"] == 20 / 1e9
    for changes, code in (({"currency": "TWD"}, "native_currency"), ({"net_income": 80.0}, "non_operating_profit"), ({"period_type": "annual"}, "no_current_quarter")):
        row = only(assess.outlook_baseline(company(spark, **changes), now()))
        assert (row["base_profit"], row["blocked"]) == (None, code)


def test_fingerprint_ignores_quotes(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0, 100.0), ("a", 1.0, 5.0, 110.0), ("a", 2.0, 5.0, 100.0), ("a", None, 5.0, 100.0)], "s string, fcf double, growth double, price double")
    keys = [r[0] for r in df.select(fundamentals.scenario_fingerprint("s", "fcf", "growth")).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3


def pending(spark, form, report, filed, snap):
    latest = spark.createDataFrame([("X", "a", form, d(filed), d(report))], "symbol string, accession string, form string, filed date, report_date date")
    shots = spark.createDataFrame([("X", d(snap[0]), d(snap[1]))] if snap else [], "symbol string, period_end date, filed_at date")
    return only(filings.pending_report(latest, shots))["pending"]


def test_pending_rule(spark):
    snap = ("2026-06-30", "2026-07-30")
    assert not pending(spark, "10-Q", "2026-06-30", "2026-07-30", snap)
    assert pending(spark, "10-Q", "2026-09-30", "2026-10-30", snap)
    assert pending(spark, "8-K", "2026-06-30", "2026-08-01", snap)
    assert not pending(spark, "8-K", "2026-06-30", "2026-07-29", snap)
    assert pending(spark, "10-Q/A", "2026-06-30", "2026-08-15", snap)
    assert pending(spark, "10-Q", "2026-06-30", "2026-07-30", None)


def test_merge_tells_absent_from_null(spark):
    old = spark.createDataFrame([("A", 320.0, 16.8), ("B", 1.0, 2.0)], "symbol string, price double, pe double")
    schema = "symbol string, price double, pe double, pe_present boolean"
    new = spark.createDataFrame([("A", None, None, False), ("B", None, None, True), ("C", 5.0, 6.0, True)], schema)
    rows = {r["symbol"]: (r["price"], r["pe"]) for r in quotes.merge_keep_last_good(old, new, ["price"], ["pe"]).collect()}
    assert rows == {"A": (320.0, 16.8), "B": (1.0, None), "C": (5.0, 6.0)}


def test_scalar_edges(spark):
    texts = ["$1,234.5", " 12% ", "n/a", "UNCH", "", "inf", "nan", "1d", "-3e2", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(S.clean_number(F.col("t"))).collect()] == [1234.5, 12, None, None, None, None, None, None, -300, None]
    cells = ["(1.2)", "−3", "$4,000", "5 million", "(-6)", "7."]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in cells], "t string").select(S.accounting_number(F.col("t"))).collect()] == [-1.2, -3, 4000, None, -6, None]
    leap = spark.createDataFrame([(d("2024-02-29"),)], "x date").select(S.years_before(F.col("x"), 10))
    assert only(leap)[0] == d("2014-02-28")
    dates = spark.createDataFrame([("Sept. 30, 2020 and Feb 30 2020, june 1 1999; Dec 24, 2101",)], "t string").select(S.text_dates(F.col("t")))
    assert only(dates)[0] == [d("2020-09-30"), d("1999-06-01")]
    names = spark.createDataFrame([("NVIDIA Corporation",), ("Apple Inc.",), ("A very long name without any suffix at all",)], "t string")
    assert [r[0] for r in names.select(S.short_name(F.col("t"), 24)).collect()] == ["NVIDIA", "Apple", "A very long name without"]


def test_a_named_day_is_found_as_among_all_dates(spark):
    texts = ["Sept. 30, 2020 and Feb 30 2020, june 1 1999", "until June 01 , 1999.", "SEP 30  2020", "Sept 130, 2020", "xJune 1 1999", "June 1 19991", "may 5,2021; May 5, 2021", None, ""]
    days = [d(x) for x in ("2020-09-30", "1999-06-01", "2021-05-05", "2020-09-13")] + [None]
    df = spark.createDataFrame([(t, x) for t in texts for x in days], "t string, day date")
    both = df.select(S.names_date(F.col("t"), F.col("day")).alias("found"), F.array_contains(S.text_dates(F.col("t")), F.col("day")).alias("listed")).collect()
    assert [bool(r["found"]) for r in both] == [bool(r["listed"]) for r in both] and sum(bool(r["found"]) for r in both) == 5
