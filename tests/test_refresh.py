"""Refreshing changed symbols gives what a full run gives, and touches nothing else."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from conftest import d, fact, facts
from pyspark.sql import functions as F

from plumbline.operators import periods, refresh, valuation
from plumbline.schemas import concept_map
from plumbline.sources.versions import with_bucket

NOW = "2031-12-31"
SYMBOLS = [f"S{i}" for i in range(12)]
POLICY = "symbol string, splits array<struct<effective_date:date,ratio:double>>"


def quarters(rng, symbol, first, last):
    out = []
    for n in range(first, last):
        start = date(2029 + n // 4, 3 * (n % 4) + 1, 1)
        end = date(2029 + (n + 1) // 4, 3 * ((n + 1) % 4) + 1, 1) - timedelta(days=1)
        out.append(fact(start.isoformat(), end.isoformat(), rng.choice([-0.2, 0.6, 1.1, 1.4]), filed=(end + timedelta(days=rng.randrange(20, 60))).isoformat(),
                        symbol=symbol, concept="EarningsPerShareDiluted", unit="USD/shares"))
    return out


def closes(spark, rng, symbols, first, last):
    rows = [(s, x, rng.uniform(20, 60)) for s in symbols for i in range((last - first).days) if (x := first + timedelta(days=i)).isoweekday() < 6]
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def policy(spark, **splits):
    return spark.createDataFrame([(s, [(d(x), float(r)) for x, r in splits.get(s, ())]) for s in SYMBOLS], POLICY)


def observed(spark, rows):
    return periods.observations(facts(spark, *rows), concept_map(spark)) if rows else None


def rows_of(df):
    return Counter(tuple(r) for r in df.select("symbol", "date", "price", "state", "eps", "eps_filed_at", "eps_period_end", "pe").collect())


def test_refreshed_states_and_ranks_equal_a_full_run(spark, tmp_path):
    rng = random.Random(4)
    stores = refresh.Stores(spark, str(tmp_path / "stores"), 8)
    known = [r for s in SYMBOLS for r in quarters(rng, s, 0, 8)]
    priced = closes(spark, rng, SYMBOLS, date(2030, 1, 1), date(2031, 3, 1))
    rules = policy(spark, S2=[("2031-01-15", 2)])
    steps = [
        (known, priced, rules, None),
        # new quarters of two symbols, one filed late for a period long ago; later prices and corrected ones of others
        (quarters(rng, "S1", 8, 10) + quarters(rng, "S3", 2, 3), closes(spark, rng, ["S5"], date(2031, 3, 1), date(2031, 6, 1)).unionByName(
            closes(spark, rng, ["S6"], date(2030, 7, 1), date(2030, 7, 9))), rules, None),
        ([], None, policy(spark, S2=[("2031-01-15", 2)], S4=[("2031-02-03", 3)]), ["S4"]),
    ]
    all_facts, all_prices = [], None
    for number, (new, prices, rules, split) in enumerate(steps):
        all_facts += new
        if prices is not None:
            latest = prices.withColumn("run", F.lit(number))
            all_prices = latest if all_prices is None else all_prices.unionByName(latest)
        before = {n: stores.table(n).manifest() for n in ("obs", "prices", "states", "months")}
        splits = spark.createDataFrame([(s,) for s in split], "symbol string") if split else None
        changes = refresh.refresh(stores, observed(spark, new), prices, rules, NOW, splits)
        full_prices = all_prices.groupBy("symbol", "date").agg(F.max_by("close", "run").alias("close"))
        full = valuation.daily_states(full_prices, periods.earnings_timeline(periods.compact(observed(spark, all_facts)), rules, NOW)).cache()
        assert rows_of(stores.table("states").read()) == rows_of(full)
        touched = {r["bucket"] for r in with_bucket(changes, ["symbol"], 8).select("bucket").distinct().collect()}
        for name, old in before.items():
            if old:
                moved = {int(b) for b, files in stores.table(name).manifest().files.items() if old.files.get(b) != files}
                assert moved <= touched and len(touched) < 8, name
        current = full.groupBy("symbol").agg(F.max_by("pe", "date").alias("pe"))
        for day, years in ((NOW, 10), ("2031-01-14", 1)):
            got = refresh.rank_from_months(stores.table("months").read(), current, day, years)
            samples = full.where("state = 'valid'").join(current.withColumnRenamed("pe", "current_pe"), "symbol").withColumn("pos", F.lit(0))
            expected = valuation.pe_percentile(samples, day, years)
            columns = ["symbol", "pe", "sample_count", "history_start", "history_end", "minimum_pe", "maximum_pe", "percentile"]
            assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, expected.select(columns).collect()))
    assert {r["symbol"] for r in changes.collect()} == {"S4"}


def test_a_refresh_reads_only_the_buckets_of_changed_symbols(spark, tmp_path):
    rng = random.Random(6)
    stores = refresh.Stores(spark, str(tmp_path / "stores"), 16)
    refresh.refresh(stores, observed(spark, [r for s in SYMBOLS for r in quarters(rng, s, 0, 5)]), closes(spark, rng, SYMBOLS, date(2030, 4, 1), date(2030, 6, 1)), policy(spark), NOW)
    one = spark.createDataFrame([("S7",)], "symbol string")
    for name in ("obs", "prices", "states", "months"):
        table = stores.table(name)
        read, whole = table.read(keys=one), table.read()
        assert len(read.inputFiles()) < len(whole.inputFiles()) / 2
        assert read.where("symbol = 'S7'").count() == whole.where("symbol = 'S7'").count()


@pytest.mark.parametrize(("what", "since"), [("obs", "2030-05-08"), ("prices", "2030-02-01"), ("both", "2030-02-01"), ("splits", "0001-01-01")])
def test_change_sets(spark, what, since):
    obs = spark.createDataFrame([("A", d("2030-05-07")), ("A", d("2030-08-01")), (None, d("2020-01-01"))], "symbol string, filed date")
    prices = spark.createDataFrame([("A", d("2030-02-01")), ("A", None)], "symbol string, date date")
    parts = {"obs": {"obs": obs}, "prices": {"prices": prices}, "both": {"obs": obs, "prices": prices}, "splits": {"obs": obs, "splits": obs.where("symbol = 'A'").select("symbol")}}
    assert [tuple(r) for r in refresh.change_set(**parts[what]).collect()] == [("A", d(since))]
