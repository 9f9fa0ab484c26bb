"""Times the headline queries and prints one JSON line.

Inputs (prices, facts, calendar and the compact observation tables) are landed first and timed on their own as `inputs`;
each query then runs in full once, results going to a sink that discards them.
"""

from __future__ import annotations

import json
import os
import time

from plumbline.plans import catalog
from plumbline.plans import fixtures as fx
from plumbline.plans import views as V
from plumbline.session import build_session

HEADLINE = (
    "daily_multiple_rank", "daily_pe", "earnings_timeline", "coverage_windows", "pe_percentile", "reference_prices", "valuation_summary",
    "publish_gate", "knowledge_summary", "standalone_quarters", "trailing_year", "financial_snapshot", "financial_quality",
    "supplement_outcomes", "assess_metrics", "compare_cash", "discounted_cash_value", "sensitivity_grid", "project_revenue_price",
    "facts_documents", "prices_feed", "quotes_feed", "relevant_filings", "recent_filings", "last_good_quotes", "quote_history",
    "catalog_search", "quote_stream", "page_text", "page_links", "report_line_items", "release_facts", "component_audit",
    "reconciled_samples", "sensitive_documents", "verify_content",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else None)
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}

    started = time.time()
    for build in (fx.prices, fx.facts, fx.calendar, fx.splits, fx.quarters, V.obs, V.current_periods, V.instants):
        build(spark, sf_dir)
    timings["inputs"] = round(time.time() - started, 3)

    for name in HEADLINE:
        started = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - started, 3)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
