"""Multiples, ranks, coverage, price checks and gates, on own series; ranks and coverage against plain Python."""

from __future__ import annotations

import math
import random
from datetime import timedelta

import numpy as np
import pytest
from conftest import d, only
from pyspark.sql import functions as F

from plumbline.operators import valuation

SAMPLES = "symbol string, date string, pe double, pos long, current_pe double"
POLICY = "symbol string, splits array<struct<effective_date:date,ratio:double>>"


def workdays(first, count):
    """Monday to Friday from a day on."""
    days, day = [], d(first)
    while len(days) < count:
        if day.isoweekday() < 6:
            days.append(day)
        day += timedelta(days=1)
    return days


def calendar_of(spark, days):
    closing = F.col("session_date").cast("timestamp") + F.expr("INTERVAL 21 HOURS")
    return spark.createDataFrame([(x,) for x in days], "session_date date").withColumn("close_ts", closing)


def closes(spark, rows):
    return spark.createDataFrame([("HELM", day, float(close)) for day, close in rows], "symbol string, date date, close double")


def splits_of(spark, *splits):
    return spark.createDataFrame([("HELM", [(d(day), float(ratio)) for day, ratio in splits])], POLICY)


# ranks


def rank_by_hand(points, current, first, last):
    kept, excluded = {}, 0
    for day, pe in points:
        if day.startswith("no") or not first <= day <= last or not math.isfinite(pe) or pe <= 0:
            excluded += 1
        else:
            kept[day] = pe
    values = list(kept.values())
    return len(kept), excluded, 100 * sum(v <= current for v in values) / len(values), min(kept), max(values)


@pytest.mark.parametrize("seed", range(4))
def test_rank_against_plain_python(spark, seed):
    rng = random.Random(seed)
    points = []
    for _ in range(180):
        day = f"{rng.randrange(2011, 2034)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
        points.append((day if rng.random() > 0.04 else "no day", rng.choice([12.5, 17.0, 17.0, 31.25, 8.0, -3.0, 0.0, float("nan"), float("inf"), rng.uniform(3, 60)])))
    points += [("2022-11-19", 44.0), ("2022-11-18", 1.0), ("2032-11-19", 2.0), ("2032-11-20", 3.0), ("2032-11-19", 2.5)]  # both borders, a repeated day
    df = spark.createDataFrame([("HELM", day, pe, i, 17.0) for i, (day, pe) in enumerate(points)], SAMPLES)
    row = only(valuation.pe_percentile(df, "2032-11-19"))
    count, excluded, rank, start, largest = rank_by_hand(points, 17.0, "2022-11-19", "2032-11-19")
    assert (row["sample_count"], row["excluded_count"], row["history_start"], row["maximum_pe"]) == (count, excluded, d(start), largest)
    assert row["percentile"] == pytest.approx(rank, abs=0.005)


def test_each_symbol_is_ranked_in_its_own_history(spark):
    rows = [(s, f"2031-0{m}-15", base + m, m, 16.0) for s, base in (("LOWE", 2.0), ("HIGH", 50.0), ("SAME", 13.0)) for m in range(1, 6)]
    found = {r["symbol"]: r["percentile"] for r in valuation.pe_percentile(spark.createDataFrame(rows, SAMPLES), "2032-11-19").collect()}
    assert found == {"LOWE": 100, "HIGH": 0, "SAME": 60}


def test_no_rank_without_a_usable_multiple(spark):
    rows = [(f"S{i}", "2031-03-15", 9.0, 0, pe) for i, pe in enumerate([0.0, -0.5, float("nan"), float("-inf"), None])]
    assert valuation.pe_percentile(spark.createDataFrame(rows, SAMPLES), "2032-11-19").count() == 0


def test_quantiles_are_linear_between_ranks(spark):
    rng = random.Random(2)
    groups = {f"S{i}": [rng.uniform(1, 90) for _ in range(n)] for i, n in enumerate((1, 2, 7, 40))}
    df = spark.createDataFrame([(s, v) for s, values in groups.items() for v in values], "symbol string, pe double")
    found = {(r["symbol"], r["percentile"]): r["pe"] for r in valuation.quantiles(df, ["symbol"]).collect()}
    expected = {(s, q): float(np.percentile(values, q)) for s, values in groups.items() for q in (20, 50, 80)}
    assert found == {k: pytest.approx(v, abs=0.006) for k, v in expected.items()}


# prices


@pytest.mark.parametrize(("before", "after", "status"), [(642.0, 214.0, "rejected"), (214.5, 211.0, "passed")])
def test_a_split_must_not_show_in_adjusted_prices(spark, before, after, status):
    days = workdays("2029-06-14", 2)
    row = only(valuation.split_continuity(closes(spark, zip(days, (before, after))), splits_of(spark, (days[1].isoformat(), 3)), "2032-11-19"))
    assert row["status"] == status and row["price_ratio"] == pytest.approx(before / after)


def test_revised_prices_need_a_reason(spark):
    days = workdays("2030-02-04", 40)
    wave = [70 + 9 * math.sin(i / 4) for i in range(40)]
    stored, third = closes(spark, zip(days, wave)), closes(spark, [(x, v / 3) for x, v in zip(days, wave)])
    touched = closes(spark, [(x, v * (1.02 if i == 17 else 1.0002)) for i, (x, v) in enumerate(zip(days, wave))])
    none = splits_of(spark)

    def rejected(new, old_policy, new_policy):
        return only(valuation.price_revision(stored, new, old_policy, new_policy))["rejected"]

    assert rejected(third, none, none)
    assert not rejected(third, none, splits_of(spark, ("2030-04-22", 3)))
    assert not rejected(touched, none.where("false"), splits_of(spark, ("2024-03-05", 2)))
    assert not rejected(stored, none, none)


# states and coverage


def test_states_follow_the_earnings_known_on_the_day(spark):
    events = [("2030-02-12", "2029-12-31", 1.6), ("2030-08-13", "2030-06-30", -0.4), ("2030-11-12", None, None), ("2031-02-18", "2030-12-31", 3.2)]
    timeline = spark.createDataFrame(
        [("HELM", d(filed) + timedelta(days=1), d(filed), d(end), eps) for filed, end, eps in events],
        "symbol string, available_on date, filed_at date, period_end date, eps double")
    expected = {
        "2030-02-12": "missing_eps", "2030-02-13": "valid", "2030-06-09": "valid", "2030-06-10": "stale_eps", "2030-08-14": "nonpositive_eps",
        "2030-11-13": "missing_eps", "2031-02-18": "missing_eps", "2031-02-19": "valid",
    }
    found = {r["date"].isoformat(): r for r in valuation.daily_states(closes(spark, [(d(x), 48) for x in expected]), timeline).collect()}
    assert {day: r["state"] for day, r in found.items()} == expected
    assert found["2030-02-13"]["pe"] == pytest.approx(30) and found["2031-02-19"]["pe"] == pytest.approx(15)


def daily_rows(spark, states):
    rows = [("HELM", day, 48.0, state, 12.0 if state == "valid" else None) for day, state in states.items()]
    return spark.createDataFrame(rows, "symbol string, date date, price double, state string, pe double")


@pytest.mark.parametrize("seed", range(3))
def test_coverage_against_plain_python(spark, seed):
    rng = random.Random(seed)
    days = workdays("2029-01-15", 560)
    states = {x: rng.choices(["valid", "missing_eps", "nonpositive_eps", None], [94, 2, 2, 2])[0] for x in days}
    hole = rng.randrange(320, 540)
    states |= {x: None for x in days[hole : hole + 5]}
    priced = {x: s for x, s in states.items() if s}
    observed = days[-1]
    window = [x for x in days if x >= observed.replace(year=observed.year - 1)]
    first = min(priced)
    missing, run, longest = 0, 0, 0
    for x in window:
        gap = states[x] in (None, "missing_eps")
        missing += gap
        run = run + 1 if gap else 0
        longest = max(longest, run)
    assert first < window[0]
    row = only(valuation.coverage_windows(daily_rows(spark, priced), calendar_of(spark, days), observed.isoformat(), horizons=(1,)))
    assert (row["expected_sessions"], row["priced_sessions"]) == (len(window), sum(states[x] is not None for x in window))
    assert (row["missing_sessions"], row["max_missing_run"]) == (missing, longest)
    assert (row["nonpositive_sessions"], row["valid_samples"]) == (sum(states[x] == "nonpositive_eps" for x in window), sum(states[x] == "valid" for x in window))
    assert not row["qualified"] and row["percentile"] is None


def test_a_whole_year_qualifies_and_a_late_start_does_not(spark):
    days = workdays("2030-03-04", 540)
    whole = only(valuation.coverage_windows(daily_rows(spark, {x: "valid" for x in days}), calendar_of(spark, days), days[-1].isoformat(), horizons=(1,)))
    assert whole["qualified"] and whole["percentile"] == 100 and whole["max_missing_run"] == 0
    window = [x for x in days if x >= days[-1].replace(year=days[-1].year - 1)]
    late = only(valuation.coverage_windows(daily_rows(spark, {x: "valid" for x in window[37:]}), calendar_of(spark, days), days[-1].isoformat(), horizons=(1,)))
    assert late["max_missing_run"] == 37 and not late["qualified"]


def test_missing_sessions_are_listed_with_their_kind(spark):
    days = workdays("2031-01-06", 240)
    states = {x: "missing_eps" if i % 80 == 33 else "valid" for i, x in enumerate(days) if i not in (60, 61, 199)}
    found = {(r["session_date"], r["state"]) for r in valuation.missing_sessions(daily_rows(spark, states), calendar_of(spark, days), days[-1].isoformat()).collect()}
    assert found == {(days[i], "missing_eps") for i in (33, 113, 193)} | {(days[i], "unpriced") for i in (60, 61, 199)}


# gates

GATED = ("symbol string, algorithm_version int, status string, pe double, percentile double, percentile10y double, current_pe_qualified boolean, "
         "as_of date, eps_period_end date, sample_count int")


def gated(spark, priced, period_end, now, version=valuation.ALGORITHM_VERSION, **more):
    row = spark.createDataFrame([("HELM", version, "limited", 31.5, 62.0, None, True, d(priced), d(period_end), 740)], GATED)
    for name, value in more.items():
        row = row.withColumn(name, F.lit(value))
    return only(valuation.publish_gate(row, calendar_of(spark, workdays("2033-04-04", 40)), F.lit(now).cast("timestamp")))


@pytest.mark.parametrize(("priced", "period_end", "now", "status", "lag"), [
    ("2033-05-05", "2033-02-28", "2033-05-08 12:00:00", "limited", 1),   # Friday is missing
    ("2033-05-04", "2033-02-28", "2033-05-08 12:00:00", "stale", 2),
    ("2033-05-05", "2033-02-28", "2033-05-09 20:59:59", "limited", 1),   # Monday counts once it has closed
    ("2033-05-05", "2033-02-28", "2033-05-09 21:00:00", "stale", 2),
    ("2033-05-06", "2032-11-29", "2033-05-08 12:00:00", "limited", 0),   # 160 days
    ("2033-05-06", "2032-11-28", "2033-05-08 12:00:00", "stale", 0),
])
def test_late_prices_or_earnings_lose_the_rank_but_keep_the_multiple(spark, priced, period_end, now, status, lag):
    row = gated(spark, priced, period_end, now)
    assert (row["status"], row["lag_sessions"], row["pe"]) == (status, lag, 31.5)
    assert (row["percentile"], row["reason"]) == ((62, None) if status == "limited" else (None, "stale_inputs"))


def test_other_versions_are_withdrawn_with_or_without_a_reason(spark):
    for more in ({}, {"reason": "short_history"}):
        row = gated(spark, "2033-05-06", "2033-02-28", "2033-05-08 12:00:00", version=valuation.ALGORITHM_VERSION - 1, **more)
        assert (row["status"], row["reason"], row["pe"], row["sample_count"]) == ("withdrawn", "other_version", None, 0)
    kept = gated(spark, "2033-05-06", "2033-02-28", "2033-05-08 12:00:00", reason="short_history")
    assert (kept["status"], kept["reason"]) == ("limited", "short_history")


def test_annual_samples_need_each_of_ten_years(spark):
    points = [(f"{year}-06-30", 90.0 - (year - 2020) * 2) for year in range(2016, 2033)]

    def ranked(rows):
        return only(valuation.annual_percentile(spark.createDataFrame([("HELM", day, pe, i, 75.0) for i, (day, pe) in enumerate(rows)], SAMPLES), "2033-02-11"))

    row = ranked(points)
    assert (row["sample_count"], row["complete"], row["frequency"], row["percentile"]) == (10, True, "annual", 50)
    assert not ranked([p for p in points if not p[0].startswith("2027")])["complete"]


def test_a_newer_report_suspends_the_rank(spark):
    schema = "symbol string, status string, pe double, percentile double, percentile10y double, current_pe_qualified boolean, eps_period_end date"
    rows = [("PEND", True, "2032-09-30"), ("NEWR", False, "2032-12-31"), ("KEEP", False, "2032-09-30"), ("NONE", None, None)]
    df = spark.createDataFrame([(s, "qualified", 22.0, 71.0, 64.0, True, d("2032-09-30")) for s, _, _ in rows], schema)
    waiting = spark.createDataFrame([(s, p, d(e)) for s, p, e in rows if s != "NONE"], "symbol string, pending boolean, period_end date")
    found = {r["symbol"]: (r["status"], r["percentile"], r["pe"]) for r in valuation.suspend_on_new_filing(df, waiting).collect()}
    assert found == {"PEND": ("incomplete", None, 22), "NEWR": ("incomplete", None, 22), "KEEP": ("qualified", 71, 22), "NONE": ("qualified", 71, 22)}
