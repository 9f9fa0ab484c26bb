"""Registered queries: coverage of the inventory, plans without slow nodes, and equality with DuckDB on a small scale.

`scripts/check_queries.py` compares all of them at any scale; here a spread of them keeps the suite short.
"""

from __future__ import annotations

import math

import duckdb
import pytest

from plumbline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = (
    "daily_multiple_rank", "earnings_timeline", "coverage_windows", "missing_sessions", "valuation_summary", "knowledge_summary", "trailing_year",
    "financial_snapshot", "financial_quality", "supplement_outcomes", "assess_metrics", "sensitivity_grid", "facts_documents", "filing_archive",
    "last_good_quotes", "merge_keep_last_good", "catalog_search_many", "quote_stream", "latest_quote_stream", "filing_stream", "results_export", "page_metadata", "page_links", "sorted_comparison", "page_text", "release_facts", "component_audit", "reconciled_samples",
    "verify_content", "sensitive_documents",
)
COUNTS = {"S": 12, "P": 23, "F": 13, "J": 16, "A": 17, "W": 11, "T": 7, "U": 7, "C": 10, "V": 12, "K": 8, "N": 11, "M": 10, "Y": 9, "Q": 5, "X": 7}


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(float(f"{value:.10g}")) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_operator_of_the_inventory_has_a_query():
    covered = {item for items in catalog.COVERS.values() for item in items}
    assert covered == {f"{letter}{number}" for letter, n in COUNTS.items() for number in range(1, n + 1)}
    assert set(catalog.QUERIES) == set(catalog.CHECKS)


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_and_plans_well(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for slow in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert slow not in plan, f"{name} plans {slow}"
    columns = sorted(df.columns)
    mine = sorted([cell(row[c]) for c in columns] for row in df.collect())
    result = db.sql(catalog.CHECKS[name])
    order = [result.columns.index(c) for c in columns]
    assert len(result.columns) == len(columns)
    assert mine == sorted([cell(row[i]) for i in order] for row in result.fetchall())


def test_reports_and_facts_leave_their_rows_without_a_shuffle(spark):
    from plumbline.operators import corpus
    from plumbline.sources import readers

    reports = spark.createDataFrame([("A", 2027, 3, "x")], "symbol string, year int, quarter int, text string")
    facts = readers.facts_from_json(spark.createDataFrame([("{}",)], "document string"))
    for df in (corpus.report_line_items(reports), facts):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Generate") == 1


def test_horizons_do_not_copy_the_series(spark):
    from plumbline.plans import views as V

    plan = V.windows(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    series = plan[plan.index("any_value") if "any_value" in plan else 0 :]
    assert "inline(_horizons" in plan and series


def test_landed_tables_follow_their_input(spark, tmp_path):
    from plumbline.session import drop_landed, landed

    folder = str(tmp_path / "in")
    build = lambda: spark.read.parquet(folder)
    spark.range(3).write.parquet(folder)
    assert landed(spark, folder, "t", build).count() == 3
    spark.range(2).write.mode("append").parquet(folder)
    assert landed(spark, folder, "t", build).count() == 5
    path = landed(spark, folder, "t", build).inputFiles()[0].removeprefix("file://")
    drop_landed(spark)
    import os

    assert not os.path.exists(path)


def test_scans_read_only_the_columns_they_need(spark):
    from plumbline.plans import fixtures as fx

    plan = fx.build_prices(spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "lineitem" in line and "ReadSchema" in line)
    assert "l_extendedprice" in scan and "l_tax" not in scan and "l_orderkey" not in scan


def test_metric_filter_prunes_the_observation_table(spark):
    from plumbline.plans import views as V

    plan = V.obs(spark, SF).where("metric = 'eps'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(metric" in plan
