"""Steps that are told the size of their input deal all their rows by it, and give what they give without."""

from __future__ import annotations

import json
import re
from collections import Counter

from conftest import d, fact, facts
from pyspark.sql import functions as F

from plumbline.operators import audit, fundamentals, matching, periods, quality, refresh, valuation
from plumbline.plans import queries_events
from plumbline.schemas import concept_map

NOW = "2031-12-31"
TASKS = 7
EPS = {"concept": "EarningsPerShareDiluted", "unit": "USD/shares"}
QUARTERS = (("01-01", "03-31"), ("04-01", "06-30"), ("07-01", "09-30"), ("10-01", "12-31"))


def rows_of(df):
    return Counter(map(repr, df.collect()))


def dealing(df):
    """Task counts of the shuffles in the plan that Spark starts from."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [int(n) for n in re.findall(r"Exchange hashpartitioning\([^\n]*?, (\d+)\)", plan)]


def unbroadcast(spark, build):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = build()
        return df, dealing(df), rows_of(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def history(spark, symbols=("A", "B", "C"), **kind):
    rows = [
        fact(f"{y}-{a}", f"{y}-{b}", 1.0 + q + len(s), filed=f"{y + q // 3}-{(3 * q + 5 - 1) % 12 + 1:02d}-05", symbol=s, accn=f"{s}{y}{q}", **kind)
        for s in symbols for y in (2028, 2029, 2030) for q, (a, b) in enumerate(QUARTERS)]
    return rows


def observed(spark, rows):
    return periods.compact(periods.observations(facts(spark, *rows), concept_map(spark)))


def policy(spark, symbols=("A", "B", "C")):
    return spark.createDataFrame([(s, []) for s in symbols], "symbol string, splits array<struct<effective_date:date,ratio:double>>")


def closes(spark, symbols=("A", "B", "C")):
    days = spark.sql("SELECT explode(sequence(date'2029-06-01', date'2031-06-30')) AS date").where("weekday(date) < 5")
    return days.withColumn("symbol", F.explode(F.array(*map(F.lit, symbols)))).select("symbol", "date", (F.dayofyear("date") + 1.0).alias("close"))


def test_timeline_is_dealt_by_the_given_number_throughout(spark):
    obs = spark.createDataFrame(observed(spark, history(spark, **EPS)).collect())
    _, _, plain = unbroadcast(spark, lambda: periods.earnings_timeline(obs, policy(spark), NOW))
    _, counts, dealt = unbroadcast(spark, lambda: periods.earnings_timeline(obs, policy(spark), NOW, TASKS))
    assert dealt == plain and sum("components=[Row" in r or "eps=" in r for r in plain) > 0
    assert set(counts) == {TASKS}


def test_audit_is_dealt_by_the_given_number_throughout(spark):
    raw = facts(spark, *history(spark, **EPS))
    timeline = periods.earnings_timeline(observed(spark, history(spark, **EPS)), policy(spark), NOW)
    parts = spark.createDataFrame(
        timeline.where("eps IS NOT NULL").select("symbol", F.col("filed_at").cast("string").alias("event_id"), F.col("filed_at").alias("observed"), F.inline("components")).collect())
    _, _, plain = unbroadcast(spark, lambda: audit.audit_components(parts, raw))
    _, counts, dealt = unbroadcast(spark, lambda: audit.audit_components(parts, raw, TASKS))
    assert dealt == plain and plain
    assert set(counts) == {TASKS}


def test_rebuilt_samples_are_dealt_by_the_given_number(spark):
    prices = closes(spark)
    timeline = spark.createDataFrame(periods.earnings_timeline(observed(spark, history(spark, **EPS)), policy(spark), NOW).drop("components").collect())
    calendar = prices.select(F.col("date").alias("session_date")).distinct()
    _, _, plain = unbroadcast(spark, lambda: audit.rebuild_samples(prices, timeline, calendar))
    df, _, dealt = unbroadcast(spark, lambda: audit.rebuild_samples(prices, timeline, calendar, TASKS))
    assert dealt == plain and plain
    assert df.select(F.spark_partition_id().alias("p")).where("p >= 4").count() > 0  # the session has four


def test_multiset_difference_counts_copies_and_nulls(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3), ("c", None)], "k string, v int")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("b", 2), (None, 3), ("d", 4)], "k string, v int")
    expected = Counter([(*r, True) for r in left.exceptAll(right).collect()]) + Counter([(*r, False) for r in right.exceptAll(left).collect()])
    for tasks in (None, TASKS):
        assert Counter(map(tuple, matching.multiset_difference(left, right, tasks).collect())) == expected
    assert dealing(matching.multiset_difference(left, right, TASKS)) == [TASKS]


def test_snapshot_and_balance_facts_are_dealt_by_the_given_number(spark):
    rows = history(spark) + history(spark, concept="NetIncomeLoss")
    current = spark.createDataFrame(periods.periods_as_of(observed(spark, rows), NOW).collect())
    _, _, plain = unbroadcast(spark, lambda: fundamentals.financial_snapshot(current))
    _, counts, dealt = unbroadcast(spark, lambda: fundamentals.financial_snapshot(current, TASKS))
    assert dealt == plain and len(plain) == 3
    assert TASKS in counts  # the session's number is left to joins of one row per symbol and metric
    balance = [fact(None, "2030-12-31", 5, filed="2031-02-01", concept="StockholdersEquity", symbol=s) for s in "ABC"]
    found = quality.instant_rows(facts(spark, *balance), concept_map(spark))
    instants = spark.createDataFrame(found.collect(), found.schema)
    ends = spark.createDataFrame([("A", d("2030-12-31")), ("B", d("2030-12-31"))], "symbol string, end date")
    _, _, plain = unbroadcast(spark, lambda: quality.instant_facts(instants, ends, NOW))
    _, counts, dealt = unbroadcast(spark, lambda: quality.instant_facts(instants, ends, NOW, TASKS))
    assert dealt == plain and len(plain) == 2
    assert TASKS in counts  # one shuffle here is not dealt yet


def test_summary_takes_a_counted_horizon(spark):
    prices = closes(spark)
    calendar = prices.select(F.col("date").alias("session_date")).distinct().withColumn("close_ts", F.expr("cast(session_date AS timestamp) + INTERVAL 21 HOURS"))
    states = valuation.daily_states(prices, periods.earnings_timeline(observed(spark, history(spark, **EPS)), policy(spark), NOW)).localCheckpoint()
    selected = valuation.selected_horizon(valuation.coverage_windows(states, calendar, NOW)).localCheckpoint()
    counted = valuation.valuation_summary(prices, states, policy(spark), calendar, NOW)
    given = valuation.valuation_summary(prices, states, policy(spark), calendar, NOW, selected=selected)
    assert rows_of(given) == rows_of(counted) and given.count() == 3


def test_a_dealt_refresh_gives_what_a_plain_one_gives(spark, tmp_path):
    found = []
    for name, tasks in (("plain", None), ("dealt", TASKS)):
        stores = refresh.Stores(spark, str(tmp_path / name), 4)
        obs, prices = observed(spark, history(spark, **EPS)), closes(spark)
        refresh.refresh(stores, obs.where("filed < '2030-06-01'"), prices.withColumn("close", F.col("close") * 2), policy(spark), NOW, tasks=tasks)
        refresh.refresh(stores, obs.where("filed >= '2030-06-01'"), prices.where("symbol <> 'B'"), policy(spark), NOW, tasks=tasks)
        found.append([rows_of(stores.table(t).read()) for t in ("obs", "prices", "states", "months")])
    assert found[0] == found[1] and all(found[0])


def test_files_of_one_document_each_are_written_by_many_tasks(spark):
    """One file per document, as the provider sends them, in a folder per task and not one per company."""
    documents = spark.range(41).selectExpr("concat('C', id) AS symbol", """concat('{"n":', id, ',"m":[1,2]}') AS document""")
    path = queries_events._files(documents, "single", "symbol <> 'C40'", 3)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/documents").selectExpr("path", "cast(content AS string) AS text").collect()
    assert sorted(json.loads(r["text"])["n"] for r in files) == list(range(40)) and all(r["text"].count("\n") > 2 for r in files)
    assert len({r["path"].rsplit("/", 1)[0] for r in files}) == 3
