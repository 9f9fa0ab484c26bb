from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import matching
from plumbline.operators.matching import lookup_join
from plumbline.schemas import concept_map

BASE = date(2020, 1, 1)


def series(spark, rng, n, extra):
    rows = {(rng.choice("AAAAAAB"), BASE + timedelta(days=rng.randint(0, 900))): rng.randint(0, 99) for _ in range(n)}
    return spark.createDataFrame([(s, t, None if v < 20 and extra else v) for (s, t), v in rows.items()], "symbol string, t date, v int")


def brute_asof(left, right):
    events = [(r["symbol"], r["t"], r["v"]) for r in right.collect()]
    out = {}
    for row in left.collect():
        fitting = [e for e in events if e[0] == row["symbol"] and e[1] <= row["t"]]
        out[(row["symbol"], row["t"])] = max(fitting, key=lambda e: e[1])[2] if fitting else "none"
    return out


def test_asof_agrees_with_brute_force_with_and_without_buckets(spark):
    rng = random.Random(1)
    left, right = series(spark, rng, 300, False), series(spark, rng, 60, True)
    expected = brute_asof(left, right)
    for bucket in (None, "month", "year"):
        rows = matching.asof_backward(left, right, ["symbol"], "t", "t", ["v"], bucket).collect()
        assert len(rows) == left.count()
        assert {(r["symbol"], r["t"]): r["event"]["v"] if r["event"] else "none" for r in rows} == expected


def test_band_join_agrees_with_brute_force(spark):
    rng = random.Random(2)
    left = series(spark, rng, 150, False).withColumnRenamed("t", "a").drop("v")
    right = series(spark, rng, 150, False).withColumnRenamed("t", "b").drop("v")
    ls, rs = left.collect(), right.collect()
    for low, high in ((60, 110), (-110, -60), (0, 8), (-400, 0), (1, 1)):
        expected = sorted((x["symbol"], x["a"], y["b"]) for x in ls for y in rs if x["symbol"] == y["symbol"] and low <= (y["b"] - x["a"]).days <= high)
        found = sorted((r["symbol"], r["a"], r["b"]) for r in matching.band_join(left, right, ["symbol"], "a", "b", low, high).collect())
        assert found == expected


def test_top_n_is_exact_for_a_key_with_most_rows(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"), F.col("id").alias("v"))
    rows = matching.top_n_per_key(df, ["k"], [F.desc("v")], 30, salts=8).collect()
    hot = sorted((r["v"] for r in rows if r["k"] == "hot"), reverse=True)
    assert hot == [v for v in range(4999, 0, -1) if v % 10 < 9][:30]
    assert {r["_rank"] for r in rows if r["k"] == "hot"} == set(range(1, 31))


def test_order_statistics_against_numpy(spark):
    rng = random.Random(8)
    groups = {"one": [4.5], "two": [1.0, 2.0], "hot": [7.0] * 4000 + [rng.uniform(0, 9) for _ in range(3000)], None: [3.0, -1.0, 3.0], "few": [rng.uniform(-5, 5) for _ in range(33)]}
    rows = [(k, v, "x") for k, values in groups.items() for v in values] + [("two", None, "x"), ("two", float("nan"), "x"), ("none", None, "x")]
    df = spark.createDataFrame(rows, "k string, v double, percentile string")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        points = (0, 20, 37, 50, 80, 100)
        found = {(r["k"], r["percentile"]): r["v"] for r in matching.order_statistics(df, ["k"], "v", points).collect()}
        assert found == {(k, p): pytest.approx(float(np.percentile(values, p))) for k, values in groups.items() for p in points}
        assert matching.order_statistics(df.limit(0), ["k"], "v", points).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_lookup_join_deals_the_rows_of_one_key_to_many_tasks(spark):
    rows = spark.range(400).select(F.lit("hot").alias("key"), F.col("id").alias("n")).unionByName(
        spark.createDataFrame([(None, -1), ("none", -2)], "key string, n bigint"))
    words = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3)], "key string, meaning int")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        joined = lookup_join(rows, words, ["key"], ["n"])
        tasks = joined.groupBy(F.spark_partition_id().alias("task")).count().collect()
        found = sorted((r["key"], r["n"], r["meaning"]) for r in joined.collect())
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 400
    assert found == sorted(("hot", n, m) for n in range(400) for m in (1, 2)) and joined.columns == ["key", "n", "meaning"]


def test_the_tag_vocabulary_is_known_to_be_small(spark):
    facts = spark.range(10).select(F.lit("Revenues").alias("concept"), F.lit("USD").alias("unit"), "id")
    joined = lookup_join(facts, concept_map(spark), ["concept", "unit"], ["id"])
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    assert {(r["metric"], r["priority"]) for r in joined.collect()} == {("revenue", 1)} and joined.count() == 10
