"""Valuation: as-of joins, daily multiples, coverage, ranks and gates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import matching, periods, refresh, valuation
from plumbline.plans import fixtures as fx
from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.plans.sql_views import AS_OF, day, r2
from plumbline.session import shared_folder


@query("daily_multiple_rank", "V1 V2 A1 J1 C7", f"""
SELECT e.symbol, {day('valuation_date')}, current_pe AS pe, count(s.pe) AS sample_count,
  {r2('1e2 * count(*) FILTER (s.pe <= current_pe) / count(s.pe)')} AS percentile
FROM v_ends e JOIN v_states s ON s.symbol = e.symbol AND s.state = 'valid'
WHERE current_pe IS NOT NULL GROUP BY e.symbol, valuation_date, current_pe""")
def daily_multiple_rank(spark, sf):
    everything = W.partitionBy("symbol")
    rows = V.build_states(spark, sf).withColumn("valuation_date", F.max("date").over(everything))
    rows = rows.withColumn("now_pe", F.max(F.when(F.col("date") == F.col("valuation_date"), F.col("pe"))).over(everything))
    return (
        rows.where("now_pe IS NOT NULL").groupBy("symbol", "valuation_date", F.col("now_pe").alias("pe"))
        .agg(F.count("pe").alias("sample_count"), valuation.empirical_rank(F.col("pe"), F.col("now_pe")).alias("percentile"))
    )


@query("daily_pe", "V1 W5", f"""
SELECT symbol, {day('date')}, price, pe, eps, {day('eps_filed_at')}, {day('eps_period_end')} FROM v_states WHERE state = 'valid'""")
def daily_pe(spark, sf):
    return valuation.daily_pe(V.clean_prices(spark, sf), V.build_timeline(spark, sf))


@query("price_earnings_asof", "J1 W5 F7", f"""
SELECT p.symbol, {day('date')}, close, {day('filed_at')}, eps, t.symbol IS NOT NULL AS matched
FROM v_clean p ASOF LEFT JOIN v_timeline t ON p.symbol = t.symbol AND p.date >= t.available_on""")
def price_earnings_asof(spark, sf):
    return matching.asof_backward(
        V.clean_prices(spark, sf), V.timeline(spark, sf), ["symbol"], "date", "available_on",
        ["filed_at", "eps"],
    ).select("symbol", "date", "close", "event.filed_at", "event.eps", F.col("event").isNotNull().alias("matched"))


@query("earnings_timeline", "C7 J2 J3 U6", f"""
SELECT symbol, {day('available_on')}, {day('filed_at')}, {day('period_end')}, eps, accession,
  CASE WHEN eps IS NULL THEN 'four_quarters_missing' END AS reason FROM v_timeline""")
def earnings_timeline(spark, sf):
    return V.build_timeline(spark, sf).drop("components")


@query("valid_prices", "F7 A16", f"SELECT symbol, {day('date')}, close FROM v_clean")
def valid_prices(spark, sf):
    raw = fx.prices(spark, sf)
    noise = raw.select("symbol", "date", F.lit(float("nan")).alias("close"), F.lit(2).alias("pos")).unionByName(
        raw.select("symbol", "date", (F.col("close") * 3).alias("close"), F.lit(0).alias("pos")))
    return valuation.valid_prices(raw.withColumn("pos", F.lit(1)).unionByName(noise), V.AS_OF)


@query("coverage_windows", "V3 A4 W4 W6", f"""
SELECT symbol, years, {day('window_start')}, {day('valuation_date')}, expected_sessions, priced_sessions, valid_samples,
  missing_sessions, nonpositive_sessions, coverage_percent, max_missing_run, qualified, percentile FROM v_windows""")
def coverage_windows(spark, sf):
    return V.windows(spark, sf)


@query("longest_missing_run", "W4", """
WITH g AS (SELECT e.symbol, session_date, s.date IS NULL AS gone FROM v_ends e JOIN fx_calendar
    ON session_date BETWEEN CAST(valuation_date - to_years(3) AS DATE) AND valuation_date
  LEFT JOIN v_clean s ON s.symbol = e.symbol AND s.date = session_date),
i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date) - row_number() OVER (PARTITION BY symbol, gone ORDER BY session_date) AS island FROM g),
r AS (SELECT symbol, gone, island, count(*) AS n FROM i GROUP BY symbol, gone, island)
SELECT symbol, coalesce(max(n) FILTER (gone), 0) AS longest_run, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS unpriced
FROM r GROUP BY symbol""")
def longest_missing_run(spark, sf):
    prices = V.clean_prices(spark, sf).withColumn("state", F.lit("valid")).withColumn("pe", F.col("close"))
    windows = valuation.coverage_windows(prices.withColumnRenamed("close", "price"), fx.calendar(spark, sf), V.AS_OF, horizons=(3,))
    return windows.select("symbol", F.col("max_missing_run").alias("longest_run"), F.col("missing_sessions").alias("unpriced"))


@query("missing_sessions", "J6", f"""
SELECT e.symbol, {day('session_date')}, coalesce(s.state, 'unpriced') AS state
FROM v_ends e JOIN fx_calendar ON session_date BETWEEN CAST(valuation_date - to_years(1) AS DATE) AND valuation_date
LEFT JOIN v_states s ON s.symbol = e.symbol AND s.date = session_date
WHERE coalesce(s.state, 'unpriced') NOT IN ('valid', 'nonpositive_eps')""")
def missing_sessions(spark, sf):
    return valuation.missing_sessions(V.states(spark, sf), fx.calendar(spark, sf), V.AS_OF, 1)


@query("horizon_counts", "W6 A4", """
SELECT e.symbol, years, count(s.pe) AS samples, min(s.pe) AS lowest, max(s.pe) AS highest
FROM v_ends e, (SELECT unnest([10, 5, 3, 1]) AS years)
JOIN v_states s ON s.symbol = e.symbol AND s.date >= CAST(valuation_date - to_years(years) AS DATE) GROUP BY ALL""")
def horizon_counts(spark, sf):
    rows = V.states(spark, sf).withColumn("last", F.max("date").over(W.partitionBy("symbol")))
    horizons = F.explode(F.array(*[F.lit(y) for y in valuation.HORIZONS])).alias("years")
    rows = rows.select("symbol", "date", "last", "pe", horizons).where(F.col("date") >= S.years_before(F.col("last"), F.col("years")))
    return rows.groupBy("symbol", "years").agg(
        F.count("pe").alias("samples"), F.min("pe").alias("lowest"), F.max("pe").alias("highest"))


@query("selected_horizon", "W9", f"SELECT symbol, {day('valuation_date')}, years, percentile, percentile10y FROM v_selected")
def selected_horizon(spark, sf):
    return valuation.selected_horizon(V.windows(spark, sf)).drop("coverage10y", "missing10y")


_SAMPLES = """
WITH raw AS (SELECT symbol, date, pe, CAST(floor(pe * 10) AS BIGINT) % 13 = 0 AS bad FROM v_states WHERE pe IS NOT NULL),
kept AS (SELECT *, date >= DATE '1998-11-04' AND NOT bad AS ok FROM raw)"""


@query("pe_percentile", "V2 A11 A17", f"""{_SAMPLES}
SELECT k.symbol, current_pe AS pe, count(*) FILTER (ok) AS sample_count, count(*) FILTER (NOT ok) AS excluded_count,
  CAST(min(date) FILTER (ok) AS VARCHAR) AS history_start, CAST(max(date) FILTER (ok) AS VARCHAR) AS history_end,
  min(pe) FILTER (ok) AS minimum_pe, max(pe) FILTER (ok) AS maximum_pe,
  {r2('1e2 * count(*) FILTER (ok AND pe <= current_pe) / count(*) FILTER (ok)')} AS percentile,
  '1998-11-04' AS window_start, '2001-11-04' AS window_end
FROM kept k JOIN v_ends USING (symbol) WHERE current_pe > 0 GROUP BY k.symbol, current_pe HAVING count(*) FILTER (ok) > 0""")
def pe_percentile(spark, sf):
    rows = V.states(spark, sf).withColumn("last", F.max("date").over(W.partitionBy("symbol")))
    rows = rows.withColumn("current_pe", F.max(F.when(F.col("date") == F.col("last"), F.col("pe"))).over(W.partitionBy("symbol")))
    bad = F.floor(F.col("pe") * 10) % 13 == 0
    samples = rows.where("pe IS NOT NULL").select(
        "symbol", F.when(bad & (F.col("date") < "2000-01-01"), "not a date").otherwise(F.col("date").cast("string")).alias("date"),
        F.when(bad, F.lit(float("nan"))).otherwise(F.col("pe")).alias("pe"), F.lit(0).alias("pos"), "current_pe")
    return valuation.pe_percentile(samples, V.AS_OF, 3)


@query("empirical_rank", "A1", f"""
SELECT symbol, count(pe) AS n, {r2('1e2 * count(*) FILTER (pe <= 1000) / count(pe)')} AS percentile
FROM v_states WHERE pe IS NOT NULL GROUP BY symbol""")
def empirical_rank(spark, sf):
    return V.states(spark, sf).where("pe IS NOT NULL").groupBy("symbol").agg(
        F.count("pe").alias("n"), valuation.empirical_rank(F.col("pe"), F.lit(1000.0)).alias("percentile"))


@query("multiple_quantiles", "A2", """
SELECT symbol, p AS percentile, round(quantile_cont(pe, p / 1e2), 6) AS pe FROM v_states, (SELECT unnest([20, 50, 80]) AS p)
WHERE pe IS NOT NULL GROUP BY symbol, p""".replace("quantile_cont(pe, p / 1e2)", "CASE p WHEN 20 THEN quantile_cont(pe, 0.2) WHEN 50 THEN quantile_cont(pe, 0.5) ELSE quantile_cont(pe, 0.8) END"))
def multiple_quantiles(spark, sf):
    samples = V.states(spark, sf).where("pe IS NOT NULL")
    return valuation.quantiles(samples, ["symbol"]).withColumn("pe", F.round("pe", 6))


@query("reference_prices", "V4", """
WITH q AS (SELECT h.symbol, quantile_cont(pe, [0.2, 0.5, 0.8]) AS v FROM v_history h JOIN v_selected s USING (symbol)
  WHERE s.years IS NOT NULL GROUP BY h.symbol)
SELECT symbol, p AS percentile, round(v[i], 6) AS pe, round(v[i] * current_eps, 6) AS price
FROM q JOIN v_ends USING (symbol), (SELECT unnest([20, 50, 80]) AS p, unnest([1, 2, 3]) AS i)""")
def reference_prices(spark, sf):
    states = V.dealt_states(spark, sf)
    eps = states.groupBy("symbol").agg(F.max_by("eps", "date").alias("eps"))
    samples = states.where("pe IS NOT NULL")
    return valuation.reference_prices(samples.drop("eps"), V.selected(spark, sf).drop("percentile"), eps).withColumns(
        {"pe": F.round("pe", 6), "price": F.round("price", 6)})


@query("split_continuity", "V5 J16", f"""
SELECT symbol, {day('effective_date')}, split_ratio, price_before, price_after, price_ratio, status FROM v_continuity""")
def split_continuity(spark, sf):
    return valuation.split_continuity(V.clean_prices(spark, sf), fx.splits(spark, sf), V.AS_OF)


_OLD = """
WITH old AS (SELECT symbol, date, close * CASE WHEN symbol = 'ASIA' AND date < DATE '1998-07-20' THEN 20e0
  WHEN ends_with(symbol, '5') THEN 2e0 WHEN ends_with(symbol, '4') THEN 1.01e0 ELSE 1e0 END AS close FROM fx_prices),
m AS (SELECT o.symbol, abs(o.close / n.close / CASE WHEN o.symbol = 'ASIA' AND o.date < DATE '1998-07-20' THEN 20e0 ELSE 1e0 END - 1) AS change
  FROM old o JOIN fx_prices n USING (symbol, date))"""


@query("price_revision", "V6 J14 A5 A7", f"""{_OLD}
SELECT symbol, count(*) AS rows, round(median(change), 9) AS median_change, count(*) >= 20 AND median(change) > 0.02 AS rejected
FROM m GROUP BY symbol""")
def price_revision(spark, sf):
    new = fx.prices(spark, sf)
    asia = (F.col("symbol") == "ASIA") & (F.col("date") < F.lit("1998-07-20").cast("date"))
    factor = F.when(asia, 20.0).when(F.col("symbol").endswith("5"), 2.0).when(F.col("symbol").endswith("4"), 1.01).otherwise(1.0)
    policy = fx.splits(spark, sf)
    before = policy.withColumn("splits", F.when(F.col("symbol") == "ASIA", F.slice("splits", 1, 0)).otherwise(F.col("splits")))
    return valuation.price_revision(new.withColumn("close", F.col("close") * factor), new, before, policy).withColumn(
        "median_change", F.round("median_change", 9))


@query("session_lag", "V7", f"""
SELECT symbol, {day('valuation_date', 'priced_on')}, (SELECT count(*) FROM fx_calendar
  WHERE session_date > valuation_date AND close_ts <= TIMESTAMP '2001-11-02 22:00:00') AS lag_sessions FROM (
  SELECT symbol, max(date) AS valuation_date FROM fx_prices GROUP BY symbol)""")
def session_lag(spark, sf):
    priced = fx.prices(spark, sf).groupBy("symbol").agg(F.max("date").alias("priced_on"))
    return valuation.session_lag(priced, fx.calendar(spark, sf), F.lit("2001-11-02 22:00:00").cast("timestamp"))


_SUMMARY = f"""symbol, algorithm_version, status, {{reason}}current_pe_qualified, frequency, {day('as_of')}, price, pe, eps_ttm,
  {day('eps_filed_at')}, {day('eps_period_end')}, horizon_years, percentile, percentile10y, sample_count, {day('history_start')},
  {day('history_end')}, earnings_yield_percent, {{lag}}, coverage_years, missing_earnings_days, nonpositive_earnings_days"""


@query("valuation_summary", "V11", f"SELECT {_SUMMARY.format(reason='reason, ', lag='lag_sessions')} FROM v_summary")
def valuation_summary(spark, sf):
    return V.build_summary(spark, sf)


_GATE = """
g AS (SELECT *, CASE WHEN ends_with(symbol, '1') THEN 3 ELSE 4 END AS version,
  (SELECT count(*) FROM fx_calendar WHERE session_date > s.as_of AND close_ts <= TIMESTAMP '2001-11-04 00:00:00') AS lag2,
  DATE '2001-11-04' - eps_period_end AS age FROM v_summary s),
f AS (SELECT *, version <> 4 AS other, coalesce(current_pe_qualified AND (lag2 > 1 OR age > 160), false) AS late FROM g)"""


def _gated(spark, sf):
    rows = V.summary(spark, sf).withColumn("algorithm_version", F.when(F.col("symbol").endswith("1"), 3).otherwise(4))
    return valuation.publish_gate(rows, fx.calendar(spark, sf), F.lit("2001-11-04 00:00:00").cast("timestamp"))


@query("publish_gate", "V8", f"""
WITH {_GATE}
SELECT symbol, CASE WHEN other THEN 'withdrawn' WHEN late THEN 'stale' ELSE status END AS status,
  CASE WHEN other THEN 'other_version' WHEN late THEN 'stale_inputs' ELSE reason END AS reason,
  CASE WHEN NOT other THEN pe END AS pe, CASE WHEN NOT other THEN CAST(eps_period_end AS VARCHAR) END AS eps_period_end,
  CASE WHEN NOT other THEN CAST(history_start AS VARCHAR) END AS history_start, current_pe_qualified AND NOT other AND NOT late AS current_pe_qualified,
  CASE WHEN NOT other AND NOT late THEN percentile END AS percentile FROM f""")
def publish_gate(spark, sf):
    return _gated(spark, sf).select("symbol", "status", "reason", "pe", "eps_period_end", "history_start", "current_pe_qualified", "percentile")


@query("published_references", "V8 V4", f"""
WITH {_GATE},
q AS (SELECT h.symbol, quantile_cont(pe, [0.2, 0.5, 0.8]) AS v FROM v_history h JOIN v_selected s USING (symbol) WHERE s.years IS NOT NULL GROUP BY h.symbol)
SELECT q.symbol, p AS percentile, round(v[i] * current_eps, 6) AS price
FROM q JOIN v_ends USING (symbol) JOIN f ON f.symbol = q.symbol AND NOT other AND NOT late, (SELECT unnest([20, 50, 80]) AS p, unnest([1, 2, 3]) AS i)""")
def published_references(spark, sf):
    return valuation.published_references(reference_prices(spark, sf), _gated(spark, sf)).select("symbol", "percentile", "price")


@query("eligible_percentile", "F9", """
SELECT symbol, CASE WHEN current_pe_qualified AND status IN ('qualified', 'limited') THEN percentile END AS eligible FROM v_summary""")
def eligible_percentile(spark, sf):
    return V.summary(spark, sf).select("symbol", valuation.eligible_percentile().alias("eligible"))


@query("annual_percentile", "V12 U3", f"""
WITH y AS (SELECT symbol, year(date) AS yr, max_by(close, date) AS pe FROM fx_prices GROUP BY ALL),
c AS (SELECT symbol, max_by(close, date) AS cur FROM fx_prices GROUP BY symbol)
SELECT symbol, cur AS pe, count(*) AS sample_count, {r2('1e2 * count(*) FILTER (y.pe <= cur) / count(*)')} AS percentile,
  count(*) AS years_found, count(*) = 6 AS complete
FROM y JOIN c USING (symbol) WHERE yr BETWEEN 1995 AND 2000 GROUP BY symbol, cur""")
def annual_percentile(spark, sf):
    prices = fx.prices(spark, sf)
    ends = prices.groupBy("symbol", F.year("date").alias("year")).agg(F.max_by("close", "date").alias("pe"))
    current = prices.groupBy("symbol").agg(F.max_by("close", "date").alias("current_pe"))
    samples = ends.join(current, "symbol").select(
        "symbol", F.concat(F.col("year").cast("string"), F.lit("-12-31")).alias("date"), "pe", F.lit(0).alias("pos"), "current_pe")
    return valuation.annual_percentile(samples, V.AS_OF, 6).select(
        "symbol", "pe", "sample_count", "percentile", "years_found", "complete")


@query("excluded_counter", "A17", """
SELECT symbol, count(*) FILTER (state = 'valid') AS valid, count(*) FILTER (state <> 'valid') AS excluded FROM v_states GROUP BY symbol""")
def excluded_counter(spark, sf):
    ok = F.col("state") == "valid"
    return V.states(spark, sf).groupBy("symbol").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("excluded"))


@query("history_extremes", "A11", f"""
SELECT symbol, min(pe) AS lowest, max(pe) AS highest, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day,
  min_by(pe, date) AS first_pe, max_by(pe, date) AS last_pe FROM v_states WHERE pe IS NOT NULL GROUP BY symbol""")
def history_extremes(spark, sf):
    return V.states(spark, sf).where("pe IS NOT NULL").groupBy("symbol").agg(
        F.min("pe").alias("lowest"), F.max("pe").alias("highest"), F.min("date").alias("first_day"),
        F.max("date").alias("last_day"), F.min_by("pe", "date").alias("first_pe"), F.max_by("pe", "date").alias("last_pe"))


@query("publish_columns", "P23", "SELECT symbol, status, pe FROM v_summary")
def publish_columns(spark, sf):
    wide = V.summary(spark, sf).select("symbol", "status", "pe", F.array("pe").alias("history"), F.array("eps_ttm").alias("earnings_timeline"))
    return S.truncate_components(wide)


@query("future_split_factor", "J3 A7 P6", f"""
SELECT symbol, concept, {day('start')}, {day('end')}, {day('filed')}, pos, factor, adjusted FROM v_factor WHERE metric = 'eps'""")
def future_split_factor(spark, sf):
    rows = periods.with_split_factor(V.raw_obs(spark, sf).where("metric = 'eps'"), fx.splits(spark, sf), periods.as_date(V.AS_OF))
    return rows.select("symbol", "concept", "start", "end", "filed", "pos",
                       F.col("split_adjustment").alias("factor"), F.col("val").alias("adjusted"))


# refresh -----------------------------------------------------------------------------------------------------------

def _refreshed(spark, sf):
    """A first run without the late filings and prices of some symbols, and with wrong prices of others; then a refresh."""
    stores, tasks = refresh.Stores(spark, shared_folder(spark, "refresh"), 16), V.series_tasks(spark, sf)
    obs, prices, splits = V.obs(spark, sf).where("metric = 'eps'"), fx.prices(spark, sf).select("symbol", "date", "close"), fx.splits(spark, sf)
    late = F.col("symbol").endswith("3") & (F.col("filed") >= F.lit("2000-01-01").cast("date"))
    missing = F.col("symbol").endswith("5") & (F.col("date") >= F.lit("2000-06-01").cast("date"))
    wrong = F.col("symbol").endswith("8") & (F.dayofmonth("date") == 11)
    first = prices.where(~missing).withColumn("close", F.when(wrong, F.col("close") * 2).otherwise(F.col("close")))
    refresh.refresh(stores, obs.where(~late), first, splits, V.AS_OF, tasks=tasks)
    refresh.refresh(stores, obs.where(late), prices.where(missing | wrong), splits, V.AS_OF, tasks=tasks)
    return stores


@query("refreshed_states", "Y5 C7 V1 S9", f"""
SELECT symbol, {day('date')}, price, state, pe, eps, {day('eps_filed_at')}, {day('eps_period_end')} FROM v_states""")
def refreshed_states(spark, sf):
    """Daily states after a refresh of the changed symbols from their first affected day."""
    return _refreshed(spark, sf).table("states").read()


@query("refreshed_ranks", "Y5 V2 A1", f"""
WITH cur AS (SELECT symbol, arg_max(pe, date) AS cur FROM v_states WHERE state = 'valid' GROUP BY symbol)
SELECT symbol, cur AS pe, count(*) AS sample_count, CAST(min(date) AS VARCHAR) AS history_start, CAST(max(date) AS VARCHAR) AS history_end,
  min(pe) AS minimum_pe, max(pe) AS maximum_pe, {r2('1e2 * count(*) FILTER (pe <= cur) / count(*)')} AS percentile
FROM v_states JOIN cur USING (symbol) WHERE state = 'valid' AND date BETWEEN {AS_OF} - INTERVAL 3 YEAR AND {AS_OF} GROUP BY symbol, cur""")
def refreshed_ranks(spark, sf):
    """Ranks over three years, read from the months that the refresh keeps."""
    stores = _refreshed(spark, sf)
    current = stores.table("states").read().where("state = 'valid'").groupBy("symbol").agg(F.max_by("pe", "date").alias("pe"))
    return refresh.rank_from_months(stores.table("months").read().repartition(V.series_tasks(spark, sf), "symbol"), current, V.AS_OF, 3)
