"""Company level: scenarios, projections, assessment, screens and verdicts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import assess, fundamentals, matching, quotes, scenarios, valuation
from plumbline.plans import fixtures as fx
from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.plans.sql_views import AS_OF, day, r2
from plumbline.session import shared_folder
from plumbline.sources.sinks import insert_absent
from plumbline.sources.versions import Table, publish_guarded


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def sql_rounded(digits, *names):
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


_VALUED = ("present_cash", "present_terminal", "value", "entry_price", "margin_at_price", "terminal_weight")


@query("discounted_cash_value", "N1", f"SELECT symbol, {sql_rounded(9, *_VALUED)} FROM v_valued")
def discounted_cash_value(spark, sf):
    return rounded(scenarios.discounted_cash_value(fx.assumptions(spark, sf)), 9, *_VALUED).select("symbol", *_VALUED)


@query("sensitivity_grid", "N2 J13", "SELECT symbol, growth_offset, return_offset, round(value, 9) AS value, round(entry_price, 9) AS entry_price FROM v_grid_valued")
def sensitivity_grid(spark, sf):
    grid = scenarios.sensitivity_grid(fx.assumptions(spark, sf))
    return rounded(grid, 9, "value", "entry_price").select("symbol", "growth_offset", "return_offset", "value", "entry_price")


@query("scenario_cells", "J13", """
SELECT symbol, g AS growth_offset, r AS return_offset, growth + g AS growth, required_return + r AS required_return
FROM fx_assumptions, (SELECT unnest([-3e0, 0e0, 3e0]) AS g), (SELECT unnest([-1e0, 0e0, 1e0]) AS r)""")
def scenario_cells(spark, sf):
    return scenarios.offset_grid(fx.assumptions(spark, sf)).select("symbol", "growth_offset", "return_offset", "growth", "required_return")


_PROJECTED = ("projected_revenue", "projected_profit", "projected_shares", "projected_eps", "projected_market_cap", "target_price")
_PROJECTION_SQL = """
WITH o AS (SELECT *, currency = 'USD' AND annual_revenue > 0 AND net_margin > 0 AND net_margin <= 100 AND first_growth > -100
  AND (years <> 2 OR second_growth > -100) AND years IN (1, 2) AS ok FROM fx_projections),
r AS (SELECT *, CASE WHEN ok THEN annual_revenue * ((1 + first_growth / 1e2) * CASE WHEN years = 2 THEN 1 + second_growth / 1e2 ELSE 1e0 END) END AS rev,
  CASE WHEN ok THEN diluted_shares * CASE WHEN years = 2 THEN (1 + annual_share_change / 1e2) * (1 + annual_share_change / 1e2) ELSE 1 + annual_share_change / 1e2 END END AS sh FROM o),
p AS (SELECT *, rev * net_margin / 1e2 AS prof FROM r)"""


@query("project_revenue_price", "N3", f"""{_PROJECTION_SQL}
SELECT symbol, round(rev, 2) AS projected_revenue, round(prof, 2) AS projected_profit, round(sh, 4) AS projected_shares, round(prof / sh, 6) AS projected_eps,
  round(prof * target_pe, 2) AS projected_market_cap, round(prof * target_pe / sh, 4) AS target_price FROM p""")
def project_revenue_price(spark, sf):
    rows = scenarios.project_revenue_price(fx.projections(spark, sf))
    digits = dict(zip(_PROJECTED, (2, 2, 4, 6, 2, 4)))
    return rows.withColumns({n: F.round(n, d) for n, d in digits.items()}).select("symbol", *_PROJECTED)


@query("relative_to_close", "N10", f"""{_PROJECTION_SQL}
SELECT symbol, round((prof * target_pe / sh / price - 1) * 100, 6) AS relative FROM p""")
def relative_to_close(spark, sf):
    rows = scenarios.project_revenue_price(fx.projections(spark, sf))
    return rows.select("symbol", F.round(scenarios.relative_to_close(F.col("target_price"), F.col("price")), 6).alias("relative"))


@query("target_month", "P22", f"""
SELECT s.symbol, CAST(CAST(period_end + to_years(n) AS DATE) AS VARCHAR) AS target, n AS years FROM v_snapshot s, (SELECT unnest([1, 2]) AS n)""")
def target_month(spark, sf):
    rows = V.snapshot(spark, sf).select("symbol", "period_end", F.explode(F.array(F.lit(1), F.lit(2))).alias("years"))
    return rows.select("symbol", S.target_month(F.col("period_end"), F.col("years")).alias("target"), "years")


@query("override_inputs", "P19", """
SELECT 'C' || c_custkey AS symbol, CASE c_custkey % 4 WHEN 0 THEN c_acctbal WHEN 1 THEN NULL WHEN 2 THEN c_custkey * 1.5e0 ELSE NULL END AS value FROM customer""")
def override_inputs(spark, sf):
    k = F.col("c_custkey")
    user = F.when(k % 4 == 1, "  ").when(k % 4 == 2, (k * 1.5).cast("string")).when(k % 4 == 3, "12abc")
    return fx.table(spark, sf, "customer").select(
        F.concat(F.lit("C"), k.cast("string")).alias("symbol"), S.override(user, F.col("c_acctbal")).alias("value"))


@query("projection_baseline", "N4", """
WITH b AS (SELECT *, CASE WHEN fresh AND currency = 'USD' THEN CASE WHEN period_type = 'quarter' AND revenue > 0 THEN revenue * 4
    WHEN period_type = 'annual' AND revenue > 0 THEN revenue WHEN revenue_ttm > 0 THEN revenue_ttm END END AS ar,
  coalesce(net_income > 0 AND operating_income > 0 AND revenue > 0 AND net_income <= operating_income * 1.5 AND net_income <= revenue, false) AS mu,
  coalesce(fresh AND q_diluted_shares > 0 AND q_period_end = period_end, false) AS so FROM v_companies)
SELECT symbol, ar AS annual_revenue, CASE WHEN ar IS NOT NULL AND mu THEN net_income / revenue * 100 END AS net_margin,
  CASE WHEN so THEN q_diluted_shares END AS diluted_shares,
  CASE WHEN NOT fresh THEN 'not_fresh' WHEN ar IS NULL OR NOT mu THEN 'margin_unusable' WHEN NOT so THEN 'shares_missing' END AS warning FROM b""")
def projection_baseline(spark, sf):
    return scenarios.projection_baseline(V.companies(spark, sf), V.today())


@query("cash_baseline", "N5", """
SELECT symbol, CASE WHEN NOT pending AND current_pe_qualified AND eps_period_end = period_end AND fresh AND q_cash_per_share_proxy > 0
  THEN round(q_cash_per_share_proxy, 9) END AS cash_per_share FROM v_companies""")
def cash_baseline(spark, sf):
    return rounded(scenarios.cash_baseline(V.companies(spark, sf), V.today()), 9, "cash_per_share")


_PRESETS = """(SELECT symbol, unnest(['base', 'conservative', 'optimistic']) AS preset,
  unnest([first_growth, greatest(0e0, floor(first_growth * 0.72e0 + 0.5e0)), floor(first_growth * 1.18e0 + 0.5e0)]) AS first_growth,
  unnest([annual_share_change, greatest(0e0, floor(annual_share_change * 0.68e0 + 0.5e0)), floor(annual_share_change * 1.25e0 + 0.5e0)]) AS second_growth,
  unnest([target_pe, greatest(8e0, floor(target_pe * 0.85e0 + 0.5e0)), floor(target_pe * 1.18e0 + 0.5e0)]) AS terminal_pe, annual_revenue
FROM fx_projections)"""


def _outlook(spark, sf):
    return fx.projections(spark, sf).select(
        "symbol", "first_growth", F.col("annual_share_change").alias("second_growth"), F.col("target_pe").alias("terminal_pe"), "annual_revenue")


@query("scenario_presets", "N6", f"SELECT symbol, preset, first_growth, second_growth, terminal_pe FROM {_PRESETS}")
def scenario_presets(spark, sf):
    return scenarios.scenario_presets(_outlook(spark, sf)).drop("annual_revenue")


@query("profit_outlook", "N7", f"""
WITH a AS (SELECT *, floor(annual_revenue / 1e9 * (1 + first_growth / 1e2) * 1e1 + 0.5e0) / 1e1 AS f FROM {_PRESETS}),
b AS (SELECT *, floor(f * (1 + second_growth / 1e2) * 1e1 + 0.5e0) / 1e1 AS s FROM a)
SELECT symbol, preset, f AS first_profit, s AS second_profit, s * 4 AS annual_profit, s * 4 * terminal_pe / 1000 AS target_market_cap FROM b""")
def profit_outlook(spark, sf):
    rows = scenarios.scenario_presets(_outlook(spark, sf)).withColumn("base_profit", F.col("annual_revenue") / F.lit(1e9))
    return scenarios.profit_outlook(rows).select("symbol", "preset", "first_profit", "second_profit", "annual_profit", "target_market_cap")


@query("review_fingerprint", "N8 P15", """
SELECT symbol, true AS stable, true AS evidence_changes FROM v_snapshot WHERE revenue_ttm IS NOT NULL""")
def review_fingerprint(spark, sf):
    rows = V.snapshot(spark, sf).where("revenue_ttm IS NOT NULL").withColumn("growth", F.lit(5.0)).withColumn("price", F.rand(7))
    evidence = ("symbol", "schema_version", "currency", "period_end", "filed_at", "revenue_ttm", "growth")
    first = fundamentals.scenario_fingerprint(*evidence)
    keyed = rows.select("*", first.alias("key")).withColumn("price", F.col("price") + 1)
    again = keyed.withColumn("key_after_quote", first).withColumn("revenue_ttm", F.col("revenue_ttm") + 1)
    again = again.withColumn("key_after_filing", first)
    return again.select(
        "symbol", (F.col("key") == F.col("key_after_quote")).alias("stable"), (F.col("key") != F.col("key_after_filing")).alias("evidence_changes"))


@query("margin_verdict", "N9", """
SELECT v.symbol, CASE WHEN price IS NULL THEN 'price_not_ready' WHEN value IS NULL THEN 'no_result' WHEN v.growth > 4 THEN 'unreviewed'
  WHEN margin_at_price >= v.safety_margin THEN 'has_margin' ELSE 'below_margin' END AS verdict
FROM v_valued v JOIN fx_assumptions a USING (symbol)""")
def margin_verdict(spark, sf):
    rows = scenarios.discounted_cash_value(fx.assumptions(spark, sf))
    verdict = scenarios.margin_verdict(
        F.col("price").isNotNull(), F.col("value"), F.col("growth") <= 4, F.col("margin_at_price"), F.col("safety_margin"))
    return rows.select("symbol", verdict.alias("verdict"))


@query("frozen_scenarios", "N11", """
SELECT symbol, '2001-10-31' AS published_at, revenue * 4 AS annual_revenue, net_income / revenue * 100 AS net_margin, q_diluted_shares AS diluted_shares,
  70e0 AS first_growth, 30e0 AS second_growth, 20e0 AS target_pe FROM v_companies WHERE symbol IN ('AMERICA', 'ASIA')""")
def frozen_scenarios(spark, sf):
    companies = V.companies(spark, sf)
    published = companies.where(F.col("symbol").isin("AMERICA", "ASIA")).select(
        "symbol", F.lit("2001-10-31").alias("published_at"), F.col("revenue").alias("quarter_revenue"), F.col("net_income").alias("quarter_profit"),
        F.lit(70.0).alias("first_growth"), F.lit(30.0).alias("second_growth"), F.lit(20.0).alias("target_pe"))
    live = companies.select("symbol", F.col("q_diluted_shares").alias("diluted_shares"))
    return scenarios.frozen_scenario(live, published)


@query("assess_metrics", "M1", "SELECT symbol, fresh, pe_valid, metric, round(value, 6) AS value, unit, state FROM v_metrics")
def assess_metrics(spark, sf):
    return rounded(assess.assess_metrics(V.companies(spark, sf), V.today()), 6, "value")


@query("assessment_state", "M2", """
WITH a AS (SELECT symbol, bool_and(fresh) AS fresh, bool_and(pe_valid) AS pe_valid, count(*) FILTER (state = 'support') AS supports,
  count(*) FILTER (state = 'caution') AS concerns, count(*) FILTER (metric IN ('cagr', 'consistency', 'roe', 'debt') AND value IS NULL) AS record_gaps
  FROM v_metrics GROUP BY symbol)
SELECT *, CASE WHEN NOT fresh OR NOT pe_valid THEN 'incomplete' WHEN concerns > 0 THEN 'caution' WHEN record_gaps > 0 THEN 'incomplete' ELSE 'research' END AS state FROM a""")
def assessment_state(spark, sf):
    return assess.assessment_state(assess.assess_metrics(V.companies(spark, sf), V.today()))


@query("abnormal_profit", "M3", "SELECT symbol, abnormal FROM v_companies")
def abnormal_profit(spark, sf):
    return V.companies(spark, sf).select("symbol", assess.abnormal_profit().alias("abnormal"))


@query("price_verdict", "M4", """
WITH r AS (SELECT *, coalesce(fresh AND eligible BETWEEN 0 AND 100 AND horizon_years > 0, false) AS ready FROM v_companies)
SELECT symbol, CASE WHEN NOT ready THEN 'unknown' WHEN abnormal THEN CASE WHEN eligible <= 20 THEN 'low_multiple_check' ELSE 'profit_check' END
    WHEN eligible <= 20 THEN 'cheap' WHEN eligible >= 80 THEN 'expensive' ELSE 'middle' END AS label,
  CASE WHEN NOT ready THEN 'not_ready' WHEN abnormal THEN 'abnormal_profit' WHEN free_cash_flow < 0 THEN 'negative_free_cash'
    WHEN fcf_delta < 0 THEN 'declining_free_cash' ELSE 'own_history_only' END AS reason,
  CASE WHEN NOT ready THEN 'neutral' WHEN abnormal THEN 'watch' WHEN eligible <= 20 THEN 'positive' WHEN eligible >= 80 THEN 'watch' ELSE 'neutral' END AS tone,
  CASE WHEN ready THEN eligible END AS percentile FROM r""")
def price_verdict(spark, sf):
    return assess.price_verdict(V.companies(spark, sf), V.today(), F.lit(True))


@query("stance_codes", "M5", f"""
WITH r AS (SELECT *, effect OR pending OR coalesce({AS_OF} - period_end > 160, false) AS flagged, coalesce({AS_OF} - period_end > 160, false) AS late FROM v_companies)
SELECT symbol, CASE WHEN flagged THEN 'profit_check' WHEN eligible IS NULL THEN 'undetermined' WHEN eligible <= 20 THEN 'low'
    WHEN eligible >= 80 THEN 'high' ELSE 'middle' END AS stance,
  CASE WHEN flagged THEN 'watch' WHEN eligible <= 20 THEN 'positive' WHEN eligible >= 80 THEN 'watch' ELSE 'neutral' END AS tone,
  CASE WHEN effect THEN 'non_operating_profit' WHEN pending OR late THEN 'finance_late' WHEN free_cash_flow < 0 THEN 'negative_free_cash'
    WHEN fcf_delta < 0 THEN 'declining_free_cash' ELSE 'keep_checking' END AS warning FROM r""")
def stance_codes(spark, sf):
    return assess.stance_codes(V.companies(spark, sf), V.today())


@query("cash_proof_status", "M6", """
SELECT symbol, CASE WHEN free_cash_flow < 0 THEN 'negative' WHEN fcf_delta IS NULL THEN 'level_only' WHEN fcf_delta > 0 THEN 'improving'
  WHEN fcf_delta < 0 THEN 'declining' ELSE 'flat' END AS status, CASE WHEN free_cash_flow < 0 THEN 'watch' WHEN fcf_delta IS NULL OR fcf_delta = 0 THEN 'neutral'
  WHEN fcf_delta > 0 THEN 'positive' ELSE 'watch' END AS tone, marginal_coverage FROM v_snapshot""")
def cash_proof_status(spark, sf):
    return assess.cash_proof_status(V.snapshot(spark, sf))


_WIDE = """
WITH w AS (SELECT symbol, bool_and(fresh) AS fresh, max(value) FILTER (metric = 'cagr') AS cagr, max(value) FILTER (metric = 'margin') AS margin,
  max(value) FILTER (metric = 'cash') AS cash, max(value) FILTER (metric = 'roe') AS roe, max(value) FILTER (metric = 'consistency') AS consistency
  FROM v_metrics GROUP BY symbol)"""
_WIDE_COLUMNS = f"symbol, fresh, {sql_rounded(6, 'cagr', 'margin', 'cash', 'roe')}, consistency"


@query("compare_cash", "M7 F10", f"{_WIDE} SELECT {_WIDE_COLUMNS} FROM w WHERE fresh AND cash > 0")
def compare_cash(spark, sf):
    metrics = assess.assess_metrics(V.companies(spark, sf), V.today())
    return rounded(assess.compare(metrics, "cash", "roe", False), 6, "cagr", "margin", "cash", "roe")


@query("compare_candidates", "M7 F10", f"{_WIDE} SELECT {_WIDE_COLUMNS} FROM w WHERE fresh AND cash > 0 AND (ends_with(symbol, '2') OR ends_with(symbol, 'A'))")
def compare_candidates(spark, sf):
    metrics = assess.assess_metrics(V.companies(spark, sf), V.today())
    drafts = V.companies(spark, sf).select("symbol", (F.col("symbol").endswith("2") | F.col("symbol").endswith("A")).alias("candidate"))
    return rounded(assess.compare(metrics, "cash", "roe", False, drafts), 6, "cagr", "margin", "cash", "roe")


@query("compare_history", "M7 F10", f"{_WIDE} SELECT {_WIDE_COLUMNS} FROM w WHERE fresh AND consistency = 5")
def compare_history(spark, sf):
    metrics = assess.assess_metrics(V.companies(spark, sf), V.today())
    return rounded(assess.compare(metrics, "history", "cagr", True), 6, "cagr", "margin", "cash", "roe")


@query("sorted_comparison", "T5 M7", f"""{_WIDE}
SELECT symbol, round(roe, 6) AS roe, row_number() OVER (ORDER BY roe DESC NULLS LAST, symbol) AS position FROM w""")
def sorted_comparison(spark, sf):
    metrics = assess.assess_metrics(V.companies(spark, sf), V.today())
    ranked = matching.global_rank(assess.compare(metrics, "all", "roe", False).select("symbol", "roe"), [F.desc_nulls_last("roe"), F.col("symbol")])
    return ranked.select("symbol", F.round("roe", 6).alias("roe"), "position")


@query("suspend_judgments", "M8", """
SELECT symbol, CASE WHEN ends_with(symbol, '2') THEN 'stale' ELSE status END AS status, pe, CASE WHEN NOT ends_with(symbol, '2') THEN percentile END AS percentile,
  current_pe_qualified AND NOT ends_with(symbol, '2') AS current_pe_qualified FROM v_summary""")
def suspend_judgments(spark, sf):
    connected = ~F.col("symbol").endswith("2")
    return assess.suspend_judgments(V.summary(spark, sf), connected).select("symbol", "status", "pe", "percentile", "current_pe_qualified")


@query("missing_evidence", "M9", """
SELECT symbol, array_to_string(list_concat(list_concat(CASE WHEN bool_and(fresh) THEN [] ELSE ['current_report'] END, CASE WHEN bool_and(pe_valid) THEN [] ELSE ['current_multiple'] END),
  list_concat(coalesce(list(metric ORDER BY list_position(['growth', 'margin', 'conversion', 'cash', 'reinvestment', 'profit_quality', 'cagr', 'consistency', 'roe', 'debt'], metric))
    FILTER (value IS NULL AND metric <> 'yield'), []), ['full_debt_and_allocation', 'competitive_advantage', 'sustainable_cash_and_margin'])), ';') AS missing
FROM v_metrics GROUP BY symbol""")
def missing_evidence(spark, sf):
    rows = assess.missing_evidence(assess.assess_metrics(V.companies(spark, sf), V.today()))
    return rows.select("symbol", F.array_join("missing", ";").alias("missing"))


@query("outlook_baseline", "M10", f"""
WITH r AS (SELECT *, coalesce(period_type = 'quarter' AND net_income > 0 AND NOT effect AND {AS_OF} - period_end <= 160 AND NOT pending, false) AS ok FROM v_companies)
SELECT symbol, CASE WHEN ok THEN net_income / 1e9 END AS base_profit, CASE WHEN effect THEN 'non_operating_profit' WHEN NOT ok THEN 'no_current_quarter' END AS blocked FROM r""")
def outlook_baseline(spark, sf):
    return assess.outlook_baseline(V.companies(spark, sf), V.today())


@query("positive_ratios", "P10", """
SELECT symbol, round(CASE WHEN revenue > 0 THEN operating_income / revenue * 1e2 END, 6) AS margin,
  round(CASE WHEN operating_cash_flow > 0 THEN capex / operating_cash_flow * 1e2 END, 6) AS reinvestment FROM v_snapshot""")
def positive_ratios(spark, sf):
    return V.snapshot(spark, sf).select(
        "symbol", F.round(S.positive_ratio(F.col("operating_income"), F.col("revenue")), 6).alias("margin"),
        F.round(S.positive_ratio(F.col("capex"), F.col("operating_cash_flow")), 6).alias("reinvestment"))


@query("growth_and_cash", "P8 P9 P11", f"""
SELECT symbol, free_cash_flow, CASE WHEN revenue_ttm > 0 THEN {r2('1e2 * (revenue * 4 / revenue_ttm - 1e0)')} END AS run_rate_change,
  CASE WHEN capex_delta > 0 THEN {r2('cash_delta / capex_delta', 4)} END AS coverage FROM v_snapshot""")
def growth_and_cash(spark, sf):
    return V.snapshot(spark, sf).select(
        "symbol", S.free_cash_flow(F.col("operating_cash_flow"), F.col("capex")).alias("free_cash_flow"),
        S.percent_change(F.col("revenue") * 4, F.col("revenue_ttm")).alias("run_rate_change"),
        S.marginal_coverage(F.col("cash_delta"), F.col("capex_delta")).alias("coverage"))


@query("pending_reports", "V9 T2", f"""
SELECT symbol, accession, form, {day('filed')}, {day('report_date')}, {day('period_end')}, pending FROM v_pending""")
def pending_reports(spark, sf):
    return V.pending(spark, sf)


@query("suspend_on_new_filing", "V10", """
WITH x AS (SELECT v.*, coalesce(p.pending, false) OR coalesce(s.period_end > v.eps_period_end, false) AS ahead
  FROM v_summary v LEFT JOIN v_pending p USING (symbol) LEFT JOIN v_snapshot s USING (symbol))
SELECT symbol, CASE WHEN current_pe_qualified AND ahead THEN 'incomplete' ELSE status END AS status, pe,
  CASE WHEN NOT (current_pe_qualified AND ahead) THEN percentile END AS percentile, current_pe_qualified AND NOT ahead AS current_pe_qualified FROM x""")
def suspend_on_new_filing(spark, sf):
    waiting = V.snapshot(spark, sf).select("symbol", "period_end").join(V.pending(spark, sf).select("symbol", "pending"), "symbol", "left")
    rows = valuation.suspend_on_new_filing(V.summary(spark, sf), waiting)
    return rows.select("symbol", "status", "pe", "percentile", "current_pe_qualified")


@query("publish_if_current", "J15", """
SELECT symbol, revenue, NOT ends_with(symbol, '6') AS accepted FROM v_snapshot""")
def publish_if_current(spark, sf):
    computed = hashed_snapshot(spark, sf)
    return quotes.publish_if_current(computed, rehashed(computed, "6")).select("symbol", "revenue", "accepted")


def hashed_snapshot(spark, sf):
    shots = V.snapshot(spark, sf).select("symbol", "revenue", "period_end")
    return shots.withColumn("input_hash", S.content_hash("symbol", "revenue", "period_end"))


def rehashed(rows, *endings):
    """The rows with the revenue of symbols that end so changed, and the hash that goes with it."""
    changed = reduce(or_, [F.col("symbol").endswith(e) for e in endings])
    rows = rows.withColumn("revenue", F.when(changed, F.col("revenue") + 1).otherwise(F.col("revenue")))
    return rows.withColumn("input_hash", S.content_hash("symbol", "revenue", "period_end"))


@query("published_versions", "J15 S9", """
SELECT symbol, revenue, 2 AS version FROM v_snapshot WHERE NOT ends_with(symbol, '6') UNION ALL
SELECT symbol, revenue + CASE WHEN ends_with(symbol, '6') OR ends_with(symbol, '3') THEN 1 ELSE 0 END, 3 FROM v_snapshot""")
def published_versions(spark, sf):
    """Results are published under the version of their inputs: those computed from old inputs wait until they are computed anew."""
    inputs, outputs = (Table(spark, shared_folder(spark, name)) for name in ("inputs", "results"))
    computed = hashed_snapshot(spark, sf)
    inputs.upsert(computed, ["symbol"], ["period_end"], 8)
    outputs.upsert(computed.limit(0), ["symbol"], ["input_hash"], 8)
    inputs.upsert(rehashed(computed, "6").where(F.col("symbol").endswith("6")), ["symbol"], ["period_end"], 8)
    publish_guarded(computed, inputs, outputs, ["symbol"], buckets=8)
    second = outputs.version()
    inputs.upsert(rehashed(computed, "3").where(F.col("symbol").endswith("3")), ["symbol"], ["period_end"], 8)
    waiting = publish_guarded(rehashed(computed, "6", "3"), inputs, outputs, ["symbol"], buckets=8)
    if not waiting.isEmpty():
        raise AssertionError("every result was current")
    return outputs.read(second).select("symbol", "revenue", F.lit(second).alias("version")).unionByName(
        outputs.read().select("symbol", "revenue", F.lit(outputs.version()).alias("version")))


@query("content_versions", "Y4 P15 S10", """
SELECT count(*) AS incoming, count(*) FILTER (ends_with(symbol, '6')) AS appended FROM v_snapshot""")
def content_versions(spark, sf):
    shots = V.snapshot(spark, sf).select("symbol", "revenue", "period_end")

    def hashed(df):
        return df.withColumn("content_hash", S.content_hash("symbol", "revenue", "period_end"))

    changed = shots.withColumn("revenue", F.when(F.col("symbol").endswith("6"), F.col("revenue") + 1).otherwise(F.col("revenue")))
    fresh = insert_absent(hashed(shots), hashed(changed), ["symbol", "content_hash"], ["period_end"])
    arrived = changed.select(F.lit(1).alias("incoming"), F.lit(0).alias("appended")).unionByName(
        fresh.select(F.lit(0).alias("incoming"), F.lit(1).alias("appended")))
    return arrived.agg(F.sum("incoming").alias("incoming"), F.sum("appended").alias("appended"))
