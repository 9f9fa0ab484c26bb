"""Balance facts, annual history and capital measures of an invented company whose year ends in September."""

from __future__ import annotations

import pytest
from conftest import d, fact, facts, only

from plumbline.operators import quality
from plumbline.schemas import concept_map

SNAPSHOT = ("symbol string, currency string, period_type string, period_end date, net_income_ttm double, operating_cash_flow_ttm double, "
            "free_cash_flow_ttm double")
END, YEAR_AGO, FILED, NOW = "2031-09-27", "2030-09-28", "2031-11-06", "2031-12-24"
SHARES = {"concept": "WeightedAverageNumberOfDilutedSharesOutstanding", "unit": "shares", "filed": FILED}


def balance(val, end=END, concept="StockholdersEquity", filed=FILED):
    return fact(None, end, val, filed, concept=concept)


def at(spark, rows, end=END, as_of=NOW):
    ends = spark.createDataFrame([("X", d(end))], "symbol string, end date")
    return [r["val"] for r in quality.instant_facts(quality.instant_rows(facts(spark, *rows), concept_map(spark)), ends, as_of).collect()]


def measures(spark, rows, kind="quarter", income=46.0, operating=230.0, free=148.0):
    shots = spark.createDataFrame([("X", "USD", kind, d(END), income, operating, free)], SNAPSHOT)
    return only(quality.financial_quality(facts(spark, *rows), concept_map(spark), shots, NOW))


def test_a_balance_holds_for_its_own_date_and_what_was_filed_by_then(spark):
    rows = [balance(915), balance(918, filed="2032-02-03"), balance(871, end="2031-06-28")]
    assert at(spark, rows) == [915] and at(spark, rows, as_of="2032-02-03") == [918]
    assert at(spark, rows, end="2031-06-28") == [871] and at(spark, rows, end="2031-09-26") == []
    assert at(spark, rows, as_of="2031-11-05") == []


def test_the_balance_listed_first_wins_among_equals(spark):
    assert at(spark, [balance(640), balance(655), balance(610)]) == [640]


HISTORY = "symbol string, period_end date, revenue double, net_income double, free_cash_flow double"


def growth(spark, years):
    """years: (period end, revenue, free cash flow)."""
    rows = [("X", d(end), float(revenue), 3.5, float(cash)) for end, revenue, cash in years]
    return only(quality.annual_summary(spark.createDataFrame(rows, HISTORY)))


def test_growth_needs_six_years_that_follow_each_other(spark):
    ends = ["2026-09-26", "2027-09-25", "2028-09-30", "2029-09-29", "2030-09-28", "2031-09-27"]
    revenues, cash = [512, 498, 533, 610, 590, 701], [7, -2, 0, 4, 9, 11]
    whole = list(zip(ends, revenues, cash, strict=True))
    row = growth(spark, whole)
    assert row["revenue_cagr5y"] == pytest.approx(100 * ((701 / 512) ** 0.2 - 1), abs=0.006)
    assert row["cash_years_positive"] == 3
    assert growth(spark, whole[1:])["revenue_cagr5y"] is None
    assert growth(spark, whole[:3] + [("2029-06-30", 610, 4)] + whole[4:])["revenue_cagr5y"] is None


def test_capital_measures(spark):
    debt = [balance(57.5, concept="LongTermDebtCurrent"), balance(402.5, concept="LongTermDebtNoncurrent")]
    equity = [balance(240, end=YEAR_AGO, filed="2030-11-05"), balance(220)]
    paid = fact("2030-09-29", END, 28, FILED, "10-K", concept="ShareBasedCompensation")
    quarter, year = fact("2031-06-29", END, 48, **SHARES), fact("2030-09-29", END, 50, **SHARES)
    row = measures(spark, [*equity, *debt, paid, quarter])
    assert row["roe_ttm"] == pytest.approx(20)          # 46 of an average of 230
    assert row["long_debt_to_ocf"] == pytest.approx(2)  # 460 of 230
    assert row["cash_per_share_proxy"] == pytest.approx(2.5)  # (148 - 28) / 48
    by_year = measures(spark, [*equity, *debt, paid, year])
    assert by_year["cash_per_share_proxy"] == pytest.approx(2.4) and by_year["shares_period"] == f"2030-09-29 / {END}"
    assert measures(spark, [*equity, *debt, paid, year], kind="annual")["cash_per_share_proxy"] is None
    assert measures(spark, [*equity, debt[1], paid, quarter])["long_debt_to_ocf"] is None
    assert measures(spark, [equity[1], *debt, paid, quarter])["roe_ttm"] is None


def test_what_was_not_reported_is_unknown_not_zero(spark):
    row = measures(spark, [fact("2031-06-29", END, 88, FILED)])
    assert [row[c] for c in ("roe_ttm", "long_debt_to_ocf", "cash_per_share_proxy", "cash_years_known")] == [None, None, None, 0]
