"""Fundamentals: periods, trailing years, snapshots, supplements and quality."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import fundamentals, matching, periods, quality
from plumbline.plans import fixtures as fx
from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.plans.sql_views import AS_OF, day, r2
from plumbline.schemas import concept_map
from plumbline.session import input_tasks

_SPAN = f"{day('start')}, {day('end')}, {day('filed')}"


@query("observations", "C1 F1 P3 P7", f"""
SELECT symbol, metric, concept, unit, priority, {_SPAN}, form, accn, val, pos FROM v_obs""")
def observations(spark, sf):
    return V.raw_obs(spark, sf).select("symbol", "metric", "concept", "unit", "priority", "start", "end", "filed", "form", "accn", "val", "pos")


@query("periods_as_of", "C2 W1 F2 A16", f"SELECT symbol, metric, {_SPAN}, val, form, accn, concept FROM v_periods")
def periods_as_of(spark, sf):
    return periods.periods_as_of(V.raw_obs(spark, sf), V.AS_OF).select("symbol", "metric", "start", "end", "filed", "val", "form", "accn", "concept")


MONTHS = 60
_DATES = f"""SELECT symbol, CAST(DATE '1996-11-03' + to_months(CAST(i AS INTEGER)) + ascii(symbol[-1]) % 20 * INTERVAL 1 DAY AS DATE) AS as_of
  FROM (SELECT DISTINCT symbol FROM fx_entities), range({MONTHS}) r(i)"""
_KNOWN = """SELECT o.symbol, as_of, metric, start, "end", filed, val, form, accn, concept FROM v_obs o JOIN d ON d.symbol = o.symbol
  AND filed <= as_of AND "end" <= as_of
QUALIFY row_number() OVER (PARTITION BY o.symbol, as_of, metric, start, "end" ORDER BY filed DESC, priority, tax DESC, pos DESC) = 1"""


def monthly_dates(spark, sf):
    """Sixty days per symbol, a month apart; the day of the month follows from the symbol."""
    step = F.explode(F.sequence(F.lit(0), F.lit(MONTHS - 1)))
    day = F.date_add(F.add_months(F.lit("1996-11-03").cast("date"), F.col("i")), F.ascii(F.substring("symbol", -1, 1)) % 20)
    return fx.entities(spark, sf).select("symbol").distinct().withColumn("i", step).select("symbol", day.alias("as_of"))


def dealt_obs(spark, sf):
    """The observations, each symbol in one of many tasks: each becomes a row for every month it is known in, and these are grouped
    where they are made."""
    return V.obs(spark, sf).repartition(input_tasks(spark, sf, 2 << 20), "symbol")


@query("periods_as_of_dates", "C2 W1 F2 J3", f"""
WITH d AS ({_DATES}), k AS ({_KNOWN}),
f AS (SELECT k.*, coalesce((SELECT product(ratio) FROM fx_splits s WHERE s.symbol = k.symbol AND effective_date > filed AND effective_date <= as_of), 1e0) AS factor
  FROM k JOIN fx_known USING (symbol) WHERE metric = 'eps')
SELECT symbol, {day('as_of')}, {_SPAN}, val / factor AS val, val AS reported_value, factor AS split_adjustment, form, accn FROM f""")
def periods_as_of_dates(spark, sf):
    """What was known of every symbol's earnings per share on each of sixty days, on the share basis of the day."""
    rows = periods.periods_as_of_dates(dealt_obs(spark, sf).where("metric = 'eps'"), monthly_dates(spark, sf), fx.splits(spark, sf))
    return rows.select("symbol", "as_of", "start", "end", "filed", "val", "reported_value", "split_adjustment", "form", "accn")


@query("known_by_dates", "C2 A16", f"""
WITH d AS ({_DATES}), k AS ({_KNOWN})
SELECT symbol, metric, {day('as_of')}, count(*) AS n_periods, CAST(max("end") AS VARCHAR) AS latest_end, CAST(max(filed) AS VARCHAR) AS last_filed,
  arg_max(val, struct_pack("end", start)) AS latest_val, arg_max(accn, struct_pack(filed, "end", start)) AS last_accn FROM k GROUP BY ALL""")
def known_by_dates(spark, sf):
    """All metrics on sixty days per symbol: how many periods were known, the latest one and the last filing."""
    rows = periods.periods_as_of_dates(dealt_obs(spark, sf), monthly_dates(spark, sf))
    return rows.groupBy("symbol", "metric", "as_of").agg(
        F.count(F.lit(1)).alias("n_periods"), F.max("end").alias("latest_end"), F.max("filed").alias("last_filed"),
        F.max_by("val", F.struct("end", "start")).alias("latest_val"), F.max_by("accn", F.struct("filed", "end", "start")).alias("last_accn"))


@query("split_adjusted_periods", "C2 J3", f"""
SELECT symbol, {_SPAN}, adjusted AS val, val AS reported_value, factor AS split_adjustment FROM v_factor WHERE metric = 'eps'
  AND filed <= DATE '1999-06-30' AND "end" <= DATE '1999-06-30'
QUALIFY row_number() OVER (PARTITION BY symbol, start, "end" ORDER BY filed DESC, priority, tax DESC, pos DESC) = 1""".replace("factor AS", f"""
  coalesce((SELECT product(ratio) FROM fx_splits s WHERE s.symbol = v_factor.symbol AND effective_date > filed AND effective_date <= DATE '1999-06-30'), 1e0) AS""").replace(
    "adjusted AS val", "val / coalesce((SELECT product(ratio) FROM fx_splits s WHERE s.symbol = v_factor.symbol AND effective_date > filed AND effective_date <= DATE '1999-06-30'), 1e0) AS val"))
def split_adjusted_periods(spark, sf):
    rows = periods.periods_as_of(V.raw_obs(spark, sf).where("metric = 'eps'"), "1999-06-30", fx.splits(spark, sf))
    return rows.select("symbol", "start", "end", "filed", "val", "reported_value", "split_adjustment")


@query("knowledge_summary", "J2 F2 U6", """
WITH d AS (SELECT DISTINCT symbol, metric, filed AS as_of FROM v_obs),
seen AS (SELECT d.symbol, d.metric, as_of, start, "end", count(DISTINCT greatest(filed, "end")) AS versions
  FROM d JOIN v_obs o ON o.symbol = d.symbol AND o.metric = d.metric AND o.filed <= as_of AND o."end" <= as_of GROUP BY ALL)
SELECT symbol, metric, CAST(as_of AS VARCHAR) AS as_of, count(start) AS periods_known, count(*) FILTER (versions > 1) AS periods_restated,
  CAST(max("end") AS VARCHAR) AS latest_end FROM d LEFT JOIN seen USING (symbol, metric, as_of) GROUP BY ALL""")
def knowledge_summary(spark, sf):
    return periods.knowledge_summary(V.obs(spark, sf))


@query("standalone_quarters", "C3", f"SELECT symbol, metric, {_SPAN}, val, form, accn, derived FROM v_quarters")
def standalone_quarters(spark, sf):
    return periods.standalone_quarters(V.current_periods(spark, sf)).select(
        "symbol", "metric", "start", "end", "filed", "val", "form", "accn", "derived")


@query("trailing_year", "C4", f"SELECT symbol, metric, rule, {_SPAN}, val FROM v_ttm")
def trailing_year(spark, sf):
    return periods.trailing_year(V.current_periods(spark, sf)).select("symbol", "metric", "rule", "start", "end", "filed", "val")


@query("trailing_year_midyear", "C4", f"SELECT symbol, metric, rule, {_SPAN}, val FROM v_ttm".replace("v_ttm", "v_ttm_mid"))
def trailing_year_midyear(spark, sf):
    rows = periods.periods_as_of(V.obs(spark, sf), "2000-03-15")
    return periods.trailing_year(rows).select("symbol", "metric", "rule", "start", "end", "filed", "val")


@query("trailing_eps", "C5 W2", f"SELECT symbol, {_SPAN}, val FROM v_eps_ttm")
def trailing_eps(spark, sf):
    return periods.trailing_eps(V.current_periods(spark, sf).where("metric = 'eps'")).select("symbol", "start", "end", "filed", "val")


_SNAP = ("symbol, schema_version, currency, period_type, {0}, form, accession, revenue, net_income, operating_income, "
         "operating_cash_flow, capex, free_cash_flow, revenue_ttm, net_income_ttm, operating_income_ttm, operating_cash_flow_ttm, "
         "capex_ttm, eps_ttm, free_cash_flow_ttm, revenue_yoy, net_income_yoy, cash_delta, capex_delta, fcf_delta, marginal_coverage, "
         "capex_concept, quarterly")


@query("financial_snapshot", "C6 J5 P8 P9 P11 W11", f"""
SELECT {_SNAP.format(', '.join(day(c) for c in ('period_start', 'period_end', 'filed_at')))} FROM v_snapshot""")
def financial_snapshot(spark, sf):
    return V.build_snapshot(spark, sf)


@query("period_type", "P21 C6", f"""
SELECT symbol, {day('period_end', 'end')}, period_type, {day('period_start', 'start')} FROM v_basis""")
def period_type(spark, sf):
    return periods.period_type(V.current_periods(spark, sf).where("metric = 'revenue'")).select("symbol", "end", "period_type", "start")


@query("latest_endpoints", "A10 U6", f'SELECT symbol, metric, CAST(max("end") AS VARCHAR) AS latest_end FROM v_periods GROUP BY ALL')
def latest_endpoints(spark, sf):
    return periods.latest_ends(V.current_periods(spark, sf))


@query("span_classes", "P6", """
SELECT symbol, CASE WHEN "end" - start BETWEEN 60 AND 110 THEN 'quarter' WHEN "end" - start BETWEEN 330 AND 400 THEN 'annual'
  WHEN "end" - start BETWEEN 50 AND 400 THEN 'ytd' END AS span, count(*) AS n FROM fx_facts WHERE start IS NOT NULL GROUP BY ALL""")
def span_classes(spark, sf):
    span = S.span_class(S.period_days(F.col("start"), F.col("end")))
    return fx.facts(spark, sf).where("start IS NOT NULL").groupBy("symbol", span.alias("span")).agg(F.count("*").alias("n"))


@query("accepted_facts", "F1 P7", """
SELECT symbol, regexp_replace(form, '/A$', '') AS base_form, count(*) AS n, CAST(min(filed) AS VARCHAR) AS first_filed FROM v_obs GROUP BY ALL""")
def accepted_facts(spark, sf):
    return V.raw_obs(spark, sf).groupBy("symbol", S.base_form(F.col("form")).alias("base_form")).agg(
        F.count("*").alias("n"), F.min("filed").alias("first_filed"))


@query("known_facts", "F2", """
SELECT symbol, metric, count(*) AS n FROM v_obs WHERE filed <= DATE '1998-06-30' AND "end" <= DATE '1998-06-30' GROUP BY ALL""")
def known_facts(spark, sf):
    return periods.known_by(V.raw_obs(spark, sf), periods.as_date("1998-06-30")).groupBy("symbol", "metric").agg(F.count("*").alias("n"))


@query("prior_year_pairs", "J4 P9", f"""
SELECT a.symbol, {day('end').replace('"end"', 'a."end"', 1)}, CAST(b."end" AS VARCHAR) AS prior_end,
  CASE WHEN b.val > 0 THEN {r2('1e2 * (a.val / b.val - 1e0)')} END AS growth
FROM v_quarters a JOIN v_quarters b ON a.symbol = b.symbol AND b.metric = 'revenue' AND abs(a."end" - b."end" - 365) <= 14
WHERE a.metric = 'revenue'""")
def prior_year_pairs(spark, sf):
    quarters = periods.standalone_quarters(V.current_periods(spark, sf).where("metric = 'revenue'"))
    then = quarters.select("symbol", F.col("end").alias("prior_end"), F.col("val").alias("prior"))
    pairs = matching.band_join(quarters.select("symbol", "end", "val"), then, ["symbol"], "end", "prior_end", -379, -351)
    return pairs.select("symbol", "end", "prior_end", S.percent_change(F.col("val"), F.col("prior")).alias("growth"))


@query("aligned_periods", "J5 P8 P10", """
SELECT symbol, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", cash - capex AS free_cash_flow,
  CASE WHEN revenue > 0 THEN operating / revenue * 1e2 END AS margin FROM (
  SELECT symbol, start, "end", max(val) FILTER (metric = 'revenue') AS revenue, max(val) FILTER (metric = 'operating_income') AS operating,
    max(val) FILTER (metric = 'operating_cash_flow') AS cash, max(val) FILTER (metric = 'capex') AS capex FROM v_periods GROUP BY ALL)
WHERE revenue IS NOT NULL""")
def aligned_periods(spark, sf):
    names = ["revenue", "operating_income", "operating_cash_flow", "capex"]
    wide = V.current_periods(spark, sf).groupBy("symbol", "start", "end").pivot("metric", names).agg(F.first("val")).where("revenue IS NOT NULL")
    return wide.select(
        "symbol", "start", "end", S.free_cash_flow(F.col("operating_cash_flow"), F.col("capex")).alias("free_cash_flow"),
        S.positive_ratio(F.col("operating_income"), F.col("revenue")).alias("margin"))


@query("trailing_frame", "W3 A3", f"""
SELECT symbol, {day('end')}, round(sum(val) OVER w, 4) AS total, CAST(min(start) OVER w AS VARCHAR) AS first_start,
  CAST(max(filed) OVER w AS VARCHAR) AS last_filed, count(*) OVER w AS n FROM v_quarters WHERE metric = 'net_income'
WINDOW w AS (PARTITION BY symbol ORDER BY "end" ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def trailing_frame(spark, sf):
    frame = W.partitionBy("symbol").orderBy("end").rowsBetween(-3, 0)
    quarters = periods.standalone_quarters(V.current_periods(spark, sf).where("metric = 'net_income'"))
    return quarters.select(
        "symbol", "end", F.round(F.sum("val").over(frame), 4).alias("total"), F.min("start").over(frame).alias("first_start"),
        F.max("filed").over(frame).alias("last_filed"), F.count("*").over(frame).alias("n"))


@query("quarter_contiguity", "W2", f"""
SELECT symbol, metric, {day('end')}, start - lag("end") OVER (PARTITION BY symbol, metric ORDER BY "end") AS gap FROM v_quarters""")
def quarter_contiguity(spark, sf):
    order = W.partitionBy("symbol", "metric").orderBy("end")
    return periods.standalone_quarters(V.current_periods(spark, sf)).select(
        "symbol", "metric", "end", F.datediff("start", F.lag("end").over(order)).cast("long").alias("gap"))


@query("quarter_deltas", "W11 P11 J4", f"""
WITH c AS (SELECT * FROM v_quarters WHERE metric = 'operating_cash_flow'), x AS (SELECT * FROM v_quarters WHERE metric = 'capex')
SELECT c.symbol, CAST(c."end" AS VARCHAR) AS "end", c.val - p.val AS cash_delta, x.val - y.val AS capex_delta,
  CASE WHEN x.val - y.val > 0 THEN {r2('(c.val - p.val) / (x.val - y.val)', 4)} END AS coverage
FROM c JOIN x ON x.symbol = c.symbol AND x."end" = c."end" AND x.start = c.start
JOIN c p ON p.symbol = c.symbol AND c."end" - p."end" BETWEEN 60 AND 110
JOIN x y ON y.symbol = p.symbol AND y."end" = p."end" AND y.start = p.start""")
def quarter_deltas(spark, sf):
    names = ["operating_cash_flow", "capex"]
    quarters = periods.standalone_quarters(V.current_periods(spark, sf).where(F.col("metric").isin(names)))
    wide = quarters.groupBy("symbol", "start", "end").pivot("metric", names).agg(F.first("val")).dropna(subset=names)
    then = wide.select("symbol", F.col("end").alias("prior_end"), F.col("operating_cash_flow").alias("cash_then"), F.col("capex").alias("capex_then"))
    pairs = matching.band_join(wide, then, ["symbol"], "end", "prior_end", -110, -60)
    cash, capex = F.col("operating_cash_flow") - F.col("cash_then"), F.col("capex") - F.col("capex_then")
    return pairs.select("symbol", "end", cash.alias("cash_delta"), capex.alias("capex_delta"), S.marginal_coverage(cash, capex).alias("coverage"))


@query("event_components", "A12 C7", f"""
SELECT symbol, {day('filed_at')}, CASE WHEN eps IS NULL THEN 0 ELSE 4 END AS components, eps FROM v_timeline""")
def event_components(spark, sf):
    total = F.aggregate("components", F.lit(0.0), lambda a, c: a + c["eps"])
    return V.timeline(spark, sf).select(
        "symbol", "filed_at", F.coalesce(F.size("components"), F.lit(0)).alias("components"), total.alias("eps"))


_CAL = """(SELECT symbol, CAST(m AS INTEGER) AS end_month, o AS year_offset, q AS quarter FROM fx_entities,
  (VALUES (9, 0, 4), (12, 1, 1), (3, 0, 2), (6, 0, 3)) v(m, o, q) WHERE ends_with(symbol, '2') GROUP BY ALL)"""


@query("fiscal_quarters", "P12", f"""
SELECT p.symbol, {day('end')}, year("end") + coalesce(year_offset, 0) AS fiscal_year, coalesce(c.quarter, quarter("end")) AS fiscal_quarter
FROM v_quarters p LEFT JOIN {_CAL} c ON c.symbol = p.symbol AND c.end_month = month("end") WHERE metric = 'revenue'""")
def fiscal_quarters(spark, sf):
    symbols = fx.entities(spark, sf).select("symbol").where("endswith(symbol, '2')").distinct()
    months = F.array(*[F.struct(F.lit(m).alias("end_month"), F.lit(o).alias("year_offset"), F.lit(q).alias("quarter"))
                       for m, o, q in ((9, 0, 4), (12, 1, 1), (3, 0, 2), (6, 0, 3))])
    calendar = symbols.select("symbol", F.inline(months))
    quarters = periods.standalone_quarters(V.current_periods(spark, sf).where("metric = 'revenue'"))
    return fundamentals.fiscal_quarter(quarters, calendar).select("symbol", "end", "fiscal_year", "fiscal_quarter")


@query("calendar_quarter_start", "P13", f"""
SELECT symbol, {day('end')}, CAST(CASE WHEN ends_with(symbol, '4') THEN date_trunc('month', "end" - INTERVAL 2 MONTH) ELSE "start" END AS DATE)::VARCHAR AS start
FROM v_periods WHERE metric = 'operating_cash_flow'""")
def calendar_quarter_start(spark, sf):
    issuers = fx.entities(spark, sf).select("symbol").where("endswith(symbol, '4')").distinct()
    rows = V.current_periods(spark, sf).where("metric = 'operating_cash_flow'")
    return fundamentals.calendar_quarter_start(rows, issuers).select("symbol", "end", "start")


_MISSING = f"""
WITH miss AS (SELECT q.symbol, q.start, q."end" FROM v_quarters q WHERE q.metric = 'revenue' AND NOT EXISTS (
  SELECT 1 FROM v_obs o WHERE o.metric = 'eps' AND o.symbol = q.symbol AND o.start = q.start AND o."end" = q."end" AND o.filed - o."end" BETWEEN 0 AND 100)),
rel AS (SELECT m.symbol, m."end", min(struct_pack(f := filed, a := accession)) AS r FROM miss m JOIN fx_nation_filings f ON f.symbol = m.symbol
  AND form = '8-K' AND items LIKE '%2.02%' AND filed - m."end" BETWEEN 1 AND 100 GROUP BY ALL)"""


@query("quarters_without_eps", "J8", f"{_MISSING} SELECT symbol, {day('start')}, {day('end')} FROM miss")
def quarters_without_eps(spark, sf):
    return fundamentals.quarters_without_timely_eps(V.obs(spark, sf), V.AS_OF).select("symbol", "start", "end")


@query("first_releases", "F5 T7", f"""
{_MISSING} SELECT m.symbol, CAST(m."end" AS VARCHAR) AS "end", CAST(r.f AS VARCHAR) AS release_filed, r.a AS release_accession
FROM miss m LEFT JOIN rel ON rel.symbol = m.symbol AND rel."end" = m."end" """)
def first_releases(spark, sf):
    missing = fundamentals.quarters_without_timely_eps(V.obs(spark, sf), V.AS_OF)
    return fundamentals.first_release(missing, fx.nation_filings(spark, sf)).select("symbol", "end", "release_filed", "release_accession")


def _supplements(spark, sf):
    quarters = fx.quarters(spark, sf).where("n % 6 = 0")
    eps = F.col("income") / F.lit(10000.0) / (F.lit(1000000.0) + F.col("n") * F.lit(1000.0))
    row = quarters.select(
        "symbol", F.col("qs").alias("start"), F.col("qe").alias("end"), F.date_add("qe", 30).alias("filed"), F.lit("8-K").alias("form"),
        F.concat_ws("-", "symbol", F.col("n").cast("string"), F.lit("s")).alias("accn"), eps.alias("val"))
    return row.withColumn("pos", F.lit(2).cast("long")).unionByName(row.withColumn("pos", F.lit(1).cast("long")).withColumn("val", F.lit(-1.0)))


@query("supplement_outcomes", "C8 J8 F5 S7", f"""
{_MISSING} SELECT m.symbol, CAST(m.start AS VARCHAR) AS start, CAST(m."end" AS VARCHAR) AS "end",
  income / 1e4 / (1e6 + n * 1e3) AS eps, CAST(r.f AS VARCHAR) AS release_filed, r.a AS release_accession,
  CASE WHEN n IS NOT NULL THEN 'supplied' WHEN r IS NULL THEN 'release_date_unavailable' ELSE 'no_unambiguous_eps' END AS outcome
FROM miss m LEFT JOIN rel ON rel.symbol = m.symbol AND rel."end" = m."end"
LEFT JOIN fx_quarters x ON x.symbol = m.symbol AND x.qe = m."end" AND n % 6 = 0""")
def supplement_outcomes(spark, sf):
    return fundamentals.supplement_quarters(V.obs(spark, sf), _supplements(spark, sf), fx.nation_filings(spark, sf), V.AS_OF)


@query("supplemented_eps", "U1 C2", f"""
WITH a AS (SELECT symbol, start, "end", filed, val, accn, priority, tax, pos FROM v_obs WHERE metric = 'eps'
  UNION ALL SELECT symbol, qs, qe, CAST(qe + 30 AS DATE), income / 1e4 / (1e6 + n * 1e3), symbol || '-' || n || '-s', 0, 0, 1e12::BIGINT FROM fx_quarters WHERE n % 6 = 0)
SELECT symbol, {day('end')}, accn, val FROM a WHERE filed <= {AS_OF} AND "end" <= {AS_OF} AND "end" - start BETWEEN 50 AND 400
QUALIFY row_number() OVER (PARTITION BY symbol, start, "end" ORDER BY filed DESC, priority, tax DESC, pos DESC) = 1""")
def supplemented_eps(spark, sf):
    facts = fundamentals.add_supplements(fx.facts(spark, sf), _supplements(spark, sf))
    obs = periods.observations(facts, concept_map(spark)).where("metric = 'eps'")
    return periods.periods_as_of(obs, V.AS_OF).select("symbol", "end", "accn", "val")


def _native(spark, sf):
    income = F.when(F.col("cents") % 13 != 0, F.col("income") / F.lit(10000.0))
    return fx.quarters(spark, sf).select(
        "symbol", F.col("qs").alias("start"), F.col("qe").alias("end"), (F.col("cents") / F.lit(100.0)).alias("revenue"), income.alias("net_income"))


@query("native_currency_annuals", "C9 A9", """
SELECT symbol, CAST(min(ys) AS VARCHAR) AS period_start, CAST(max(qe) AS VARCHAR) AS period_end, round(sum(cents / 1e2), 4) AS revenue,
  CASE WHEN bool_and(cents % 13 <> 0) THEN round(sum(income / 1e4), 4) END AS net_income, CAST(NULL AS DOUBLE) AS free_cash_flow
FROM fx_quarters GROUP BY symbol, ys HAVING count(*) = 4""")
def native_currency_annuals(spark, sf):
    return fundamentals.native_currency_annuals(_native(spark, sf)).withColumns(
        {"revenue": F.round("revenue", 4), "net_income": F.round("net_income", 4)})


@query("native_currency_snapshot", "C10", f"""
WITH q AS (SELECT *, CASE WHEN cents % 13 <> 0 THEN income / 1e4 END AS inc, cents / 1e2 AS rev FROM fx_quarters),
l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY qe DESC) AS rn, lag(cash_flow) OVER o AS cf0, lag(capex) OVER o AS cx0 FROM q WINDOW o AS (PARTITION BY symbol ORDER BY qe)),
t AS (SELECT symbol, CASE WHEN count(*) = count(inc) THEN round(sum(inc), 4) END AS ttm FROM l WHERE rn <= 4 GROUP BY symbol)
SELECT l.symbol, 'TWD' AS currency, CAST(l.qe AS VARCHAR) AS period_end, l.rev AS revenue, l.inc AS net_income,
  CASE WHEN NOT starts_with(l.symbol, 'A') THEN l.cash_flow / 1e4 END AS operating_cash_flow, CASE WHEN NOT starts_with(l.symbol, 'A') THEN l.capex / 1e4 END AS capex,
  CASE WHEN y.rev > 0 THEN {r2('1e2 * (l.rev / y.rev - 1e0)')} END AS revenue_yoy,
  CASE WHEN y.inc > 0 THEN {r2('1e2 * (l.inc / y.inc - 1e0)')} END AS net_income_yoy,
  CASE WHEN NOT starts_with(l.symbol, 'A') THEN l.cash_flow / 1e4 - l.cf0 / 1e4 END AS cash_delta, CASE WHEN NOT starts_with(l.symbol, 'A') THEN l.capex / 1e4 - l.cx0 / 1e4 END AS capex_delta,
  ttm AS net_income_ttm, CASE WHEN starts_with(l.symbol, 'A') THEN 'cash_lines_missing' ELSE 'ok' END AS status
FROM l JOIN t USING (symbol) LEFT JOIN q y ON y.symbol = l.symbol AND y.n = l.n - 4 WHERE l.rn = 1""")
def native_currency_snapshot(spark, sf):
    order = W.partitionBy("symbol").orderBy("qe")
    cash, capex = F.col("cash_flow") / F.lit(10000.0), -F.col("capex") / F.lit(10000.0)
    lines = fx.quarters(spark, sf).select(
        "symbol", F.col("qe").alias("end"), (F.col("operating") / F.lit(10000.0)).alias("operating_income"),
        cash.alias("operating_cash_flow"), F.lag(cash).over(order).alias("operating_cash_flow_previous"),
        capex.alias("capex"), F.lag(capex).over(order).alias("capex_previous")).where(~F.col("symbol").startswith("A"))
    return fundamentals.native_currency_snapshot(_native(spark, sf), lines).select(
        "symbol", "currency", "period_end", "revenue", "net_income", "operating_cash_flow", "capex", "revenue_yoy",
        "net_income_yoy", "cash_delta", "capex_delta", F.round("net_income_ttm", 4).alias("net_income_ttm"), "status")


@query("instant_facts", "K1 F3", f"""
SELECT i.symbol, metric, {day('end')}, val, CAST(filed AS VARCHAR) AS filed, accn, concept FROM v_instants i""")
def instant_facts(spark, sf):
    rows = quality.instant_rows(fx.facts(spark, sf), concept_map(spark))
    return quality.instant_facts(rows, rows.select("symbol", "end").distinct(), V.AS_OF)


@query("annual_history", "K2 W7 J5", f"""
SELECT symbol, {day('period_start')}, {day('period_end')}, {day('filed_at')}, accession, revenue, net_income, operating_income,
  operating_cash_flow, capex, share_compensation, free_cash_flow FROM v_annual_history""")
def annual_history(spark, sf):
    return quality.annual_history(V.current_periods(spark, sf))


_SUMMARY_COLUMNS = "history_contiguous, round(revenue_cagr5y, 6) AS revenue_cagr5y, cash_years_known, cash_years_positive, profit_years_known, profit_years_positive"


@query("annual_summary", "K3 A8 W7 W8", f"SELECT symbol, {_SUMMARY_COLUMNS} FROM v_annual_summary")
def annual_summary(spark, sf):
    history = quality.annual_history(V.current_periods(spark, sf))
    return quality.annual_summary(history).withColumn("revenue_cagr5y", F.round("revenue_cagr5y", 6))


@query("annual_steps", "W8", f"""
SELECT symbol, {day('period_end')}, coalesce(period_end - lag(period_end) OVER (PARTITION BY symbol ORDER BY period_end) BETWEEN 330 AND 400, true) AS joined
FROM v_annual_history""")
def annual_steps(spark, sf):
    order = W.partitionBy("symbol").orderBy("period_end")
    step = F.datediff("period_end", F.lag("period_end").over(order))
    return quality.annual_history(V.current_periods(spark, sf)).select(
        "symbol", "period_end", F.coalesce(step.between(330, 400), F.lit(True)).alias("joined"))


@query("positive_years", "A8", """
SELECT symbol, count(free_cash_flow) AS cash_known, count(*) FILTER (free_cash_flow > 0) AS cash_positive,
  count(*) FILTER (net_income > 0) AS profit_positive FROM v_annual_history GROUP BY symbol""")
def positive_years(spark, sf):
    return quality.annual_history(V.current_periods(spark, sf)).groupBy("symbol").agg(
        F.count("free_cash_flow").alias("cash_known"), F.count_if(F.col("free_cash_flow") > 0).alias("cash_positive"),
        F.count_if(F.col("net_income") > 0).alias("profit_positive"))


@query("financial_quality", "K3 K4 K5 K6 K7", f"""
SELECT symbol, version, currency, {day('period_end')}, {_SUMMARY_COLUMNS}, round(roe_ttm, 6) AS roe_ttm, equity, long_debt,
  round(long_debt_to_ocf, 9) AS long_debt_to_ocf, cash, short_borrowings, commercial_paper, share_compensation_ttm, diluted_shares,
  shares_period, round(cash_per_share_proxy, 9) AS cash_per_share_proxy FROM v_quality""")
def financial_quality(spark, sf):
    digits = {"revenue_cagr5y": 6, "roe_ttm": 6, "long_debt_to_ocf": 9, "cash_per_share_proxy": 9}
    return V.build_quality(spark, sf).withColumns({name: F.round(name, n) for name, n in digits.items()})


@query("return_on_equity", "K4", "SELECT symbol, round(roe_ttm, 6) AS roe_ttm FROM v_quality WHERE roe_ttm IS NOT NULL")
def return_on_equity(spark, sf):
    rows = V.instants(spark, sf).where("metric = 'equity'")
    shots = V.snapshot(spark, sf).select("symbol", "period_end", "net_income_ttm")
    now = quality.instant_facts(rows, shots.select("symbol", F.col("period_end").alias("end")), V.AS_OF).select("symbol", F.col("val").alias("equity"))
    then = quality.instant_facts(rows, quality.prior_equity_ends(fx.facts(spark, sf), shots), V.AS_OF).select("symbol", F.col("val").alias("before"))
    roe = quality.return_on_equity(F.col("net_income_ttm"), F.col("equity"), F.col("before"))
    return shots.join(now, "symbol").join(then, "symbol").select("symbol", F.round(roe, 6).alias("roe_ttm")).where("roe_ttm IS NOT NULL")


@query("debt_to_cash_flow", "K5", "SELECT symbol, long_debt, round(long_debt_to_ocf, 9) AS ratio FROM v_quality")
def debt_to_cash_flow(spark, sf):
    rows = V.instants(spark, sf)
    shots = V.snapshot(spark, sf).select("symbol", "period_end", "operating_cash_flow_ttm")
    debt = quality.instant_facts(rows, shots.select("symbol", F.col("period_end").alias("end")), V.AS_OF).groupBy("symbol").pivot(
        "metric", ["current_long_debt", "noncurrent_long_debt"]).agg(F.first("val"))
    ratio = quality.debt_to_cash_flow(F.col("current_long_debt"), F.col("noncurrent_long_debt"), F.col("operating_cash_flow_ttm"))
    return shots.join(debt, "symbol", "left").select(
        "symbol", (F.col("current_long_debt") + F.col("noncurrent_long_debt")).alias("long_debt"), F.round(ratio, 9).alias("ratio"))


@query("diluted_shares", "K6", "SELECT symbol, diluted_shares, shares_period FROM v_shares")
def diluted_shares(spark, sf):
    return quality.diluted_shares(V.current_periods(spark, sf), V.snapshot(spark, sf)).drop("shares_start")


@query("cash_per_share_proxy", "K7", "SELECT symbol, round(cash_per_share_proxy, 9) AS proxy FROM v_quality")
def cash_per_share_proxy(spark, sf):
    return V.quality_record(spark, sf).select("symbol", F.round("cash_per_share_proxy", 9).alias("proxy"))


@query("balance_evidence", "K8", """
SELECT i.symbol, count(*) AS items, max(val) FILTER (metric = 'equity') AS equity, max(accn) FILTER (metric = 'cash') AS cash_accession
FROM v_instants i JOIN v_snapshot s ON s.symbol = i.symbol AND s.period_end = i."end" GROUP BY i.symbol""")
def balance_evidence(spark, sf):
    rows = V.instants(spark, sf)
    ends = V.snapshot(spark, sf).select("symbol", F.col("period_end").alias("end"))
    evidence = quality.balance_evidence(quality.instant_facts(rows, ends, V.AS_OF))
    return evidence.select(
        "symbol", F.size("balance_evidence").alias("items"), F.col("balance_evidence")["equity"]["val"].alias("equity"),
        F.col("balance_evidence")["cash"]["accn"].alias("cash_accession"))


@query("snapshot_status", "C6", """
WITH p AS (SELECT * FROM v_periods WHERE NOT (metric = 'revenue' AND ends_with(symbol, 'A'))),
h AS (SELECT symbol, max("end") AS last, string_agg(DISTINCT metric, ',' ORDER BY metric) AS metrics FROM p GROUP BY symbol),
a AS (SELECT coalesce(h.symbol, s.symbol) AS symbol, last, coalesce(metrics, '') AS metrics FROM h FULL JOIN (SELECT 'C' || c_custkey AS symbol FROM customer) s ON h.symbol = s.symbol)
SELECT a.symbol, CAST(last AS VARCHAR) AS latest_end, metrics, CAST(v.period_end AS VARCHAR) AS period_end, v.revenue_ttm,
  CASE WHEN v.revenue_ttm IS NOT NULL THEN 'complete' WHEN v.period_end IS NOT NULL THEN 'partial' WHEN last IS NOT NULL THEN 'no_revenue' ELSE 'no_periods' END AS status
FROM a LEFT JOIN (SELECT * FROM v_snapshot WHERE NOT ends_with(symbol, 'A')) v ON a.symbol = v.symbol""")
def snapshot_status(spark, sf):
    """Every symbol with periods or on the list; symbols that end in A have lost their revenue."""
    rows = V.current_periods(spark, sf).where(~((F.col("metric") == "revenue") & F.col("symbol").endswith("A")))
    listed = fx.table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"))
    found = fundamentals.snapshot_status(rows, fundamentals.financial_snapshot(rows), listed)
    return found.select("symbol", "latest_end", "metrics", "period_end", "revenue_ttm", "status")
