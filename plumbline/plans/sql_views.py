"""The fixture views and shared intermediate results as DuckDB SQL, used only to check results.

`complete(body)` puts the views a statement mentions, and those they mention, in front of it.
"""

from __future__ import annotations

import re

AS_OF = "DATE '2001-11-04'"

_SUMS = ("cents", "qty", "income", "operating", "cash_flow", "capex")

VIEWS: dict[str, str] = {}

VIEWS["fx_supplier_days"] = f"""
SELECT l_suppkey, date, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _SUMS)} FROM (
  SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date, cents, CAST(l_quantity AS BIGINT) AS qty,
    cents * (20 - 4 * disc + CASE WHEN l_returnflag = 'A' THEN 10 ELSE 0 END) AS income,
    cents * (15 - disc - CASE WHEN l_returnflag = 'R' THEN 12 ELSE 0 END) AS operating,
    cents * (12 - tax) AS cash_flow, cents * (2 * l_linenumber) AS capex
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS disc,
          CAST(round(l_tax * 100) AS BIGINT) AS tax FROM lineitem))
GROUP BY l_suppkey, date"""

VIEWS["fx_entities"] = """
SELECT s_suppkey, s_acctbal, unnest([r_name, n_name, s_name]) AS symbol
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

VIEWS["fx_prices"] = """
SELECT symbol, date, floor(CAST(sum(cents) AS BIGINT) * 1e2 / CAST(sum(qty) AS BIGINT) + 0.5e0) / 1e4 AS close
FROM fx_supplier_days JOIN fx_entities ON l_suppkey = s_suppkey GROUP BY symbol, date"""

VIEWS["fx_calendar"] = """
SELECT session_date, CAST(session_date AS TIMESTAMP) + INTERVAL 21 HOUR AS close_ts FROM (
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS session_date
  FROM (SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem))
WHERE isodow(session_date) < 6"""

VIEWS["fx_known"] = "SELECT DISTINCT symbol FROM fx_entities WHERE NOT ends_with(symbol, '7')"

VIEWS["fx_splits"] = """
SELECT symbol, effective_date, ratio FROM fx_known JOIN (VALUES
  ('AMERICA', DATE '1997-06-02', 4e0), ('AMERICA', DATE '1999-03-01', 10e0), ('ASIA', DATE '1998-07-20', 20e0)
) AS s(symbol, effective_date, ratio) USING (symbol)"""

VIEWS["fx_quarters"] = f"""
SELECT *, count(*) OVER y AS known,
  {', '.join(f'CAST(sum({c}) OVER y AS BIGINT) AS ytd_{c}' for c in _SUMS)},
  CAST(sum(cents) OVER (PARTITION BY symbol ORDER BY qs) AS BIGINT) AS life_cents
FROM (
  SELECT symbol, qs, CAST(qs + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS qe, CAST(date_trunc('year', qs) AS DATE) AS ys,
    quarter(qs) AS q, (year(qs) - 1995) * 4 + quarter(qs) - 1 AS n, {', '.join(_SUMS)}
  FROM (SELECT symbol, CAST(date_trunc('quarter', date) AS DATE) AS qs, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _SUMS)}
        FROM fx_supplier_days JOIN fx_entities ON l_suppkey = s_suppkey GROUP BY ALL))
WINDOW y AS (PARTITION BY symbol, ys ORDER BY qs)"""

_INTERIM, _LATER, _YEAR, _WHOLE = "q < 4", "q IN (2, 3)", "(q = 4 AND known = 4)", "q = known"
_SHARES = "(1e6 + n * 1e3)"
_EPS, _YEPS = f"income / 1e4 / {_SHARES}", f"ytd_income / 1e4 / {_SHARES}"
_REV, _OCF, _CAPEX = "Revenues", "NetCashProvidedByUsedInOperatingActivities", "PaymentsToAcquirePropertyPlantAndEquipment"
_SHARE_TAG, _EPS_TAG = "WeightedAverageNumberOfDilutedSharesOutstanding", "EarningsPerShareDiluted"
_FACTS = [
    (1, "us-gaap", _REV, "USD", "qs", 35, "10-Q", "cents / 1e2 + 1", _INTERIM),
    (2, "us-gaap", "RevenueFromContractWithCustomerExcludingAssessedTax", "USD", "qs", 35, "10-Q", "cents / 1e2", f"{_INTERIM} AND n >= 12"),
    (3, "us-gaap", _REV, "USD", "ys", 35, "10-Q", "ytd_cents / 1e2", f"{_LATER} AND {_WHOLE}"),
    (4, "us-gaap", _REV, "USD", "ys", 60, "10-K", "ytd_cents / 1e2", _YEAR),
    (5, "ifrs-full", _REV, "USD", "qs", 35, "10-Q", "cents / 1e2 + 2", f"{_INTERIM} AND n % 4 = 1"),
    (6, "us-gaap", _REV, "USD", "qs", 200, "10-Q/A", "cents / 1e2 * 1.02e0", f"{_INTERIM} AND n % 5 = 0"),
    (7, "us-gaap", _REV, "USD", "qs", 35, "S-1", "cents / 1e2 * 3", "n % 7 = 0"),
    (8, "us-gaap", _REV, "USD", "CAST(qe - 20 AS DATE)", 35, "10-Q", "cents / 1e2 / 4", "n % 7 = 1"),
    (9, "us-gaap", _REV, "USD", "qs", 36, "10-Q", "NULL", "n % 7 = 2"),
    (10, "us-gaap", "NetIncomeLoss", "USD", "qs", 35, "10-Q", "income / 1e4", _INTERIM),
    (11, "us-gaap", "NetIncomeLoss", "USD", "ys", 35, "10-Q", "ytd_income / 1e4", f"{_LATER} AND {_WHOLE}"),
    (12, "us-gaap", "NetIncomeLoss", "USD", "ys", 60, "10-K", "ytd_income / 1e4", _YEAR),
    (13, "ifrs-full", "ProfitLoss", "USD", "qs", 35, "10-Q", "income / 1e4 + 5", f"{_INTERIM} AND n % 3 = 0"),
    (14, "us-gaap", "OperatingIncomeLoss", "USD", "qs", 35, "10-Q", "operating / 1e4", _INTERIM),
    (15, "us-gaap", "OperatingIncomeLoss", "USD", "ys", 35, "10-Q", "ytd_operating / 1e4", f"{_LATER} AND {_WHOLE}"),
    (16, "us-gaap", "OperatingIncomeLoss", "USD", "ys", 60, "10-K", "ytd_operating / 1e4", _YEAR),
    (17, "us-gaap", _OCF, "USD", "ys", 35, "10-Q", "ytd_cash_flow / 1e4", f"{_INTERIM} AND {_WHOLE}"),
    (18, "us-gaap", _OCF, "USD", "ys", 60, "10-K", "ytd_cash_flow / 1e4", _YEAR),
    (19, "us-gaap", _CAPEX, "USD", "ys", 35, "10-Q", "ytd_capex / 1e4", f"{_INTERIM} AND {_WHOLE}"),
    (20, "us-gaap", _CAPEX, "USD", "ys", 60, "10-K", "ytd_capex / 1e4", _YEAR),
    (21, "us-gaap", _EPS_TAG, "USD/shares", "qs", 35, "10-Q", _EPS, f"{_INTERIM} AND cents % 11 <> 0"),
    (22, "us-gaap", _EPS_TAG, "USD/shares", "qs", 30, "8-K", _EPS, "q = 4 AND cents % 11 <> 0"),
    (23, "us-gaap", _EPS_TAG, "USD/shares", "ys", 60, "10-K", _YEPS, _YEAR),
    (24, "us-gaap", _EPS_TAG, "USD/shares", "qs", 200, "10-Q/A", f"{_EPS} * 1.02e0", "n % 5 = 0 AND cents % 11 <> 0"),
    (25, "us-gaap", "ShareBasedCompensation", "USD", "ys", 35, "10-Q", "ytd_qty * 1e1", f"{_INTERIM} AND {_WHOLE}"),
    (26, "us-gaap", "ShareBasedCompensation", "USD", "ys", 60, "10-K", "ytd_qty * 1e1", _YEAR),
    (27, "us-gaap", _SHARE_TAG, "shares", "qs", 35, "10-Q", _SHARES, _INTERIM),
    (28, "us-gaap", _SHARE_TAG, "shares", "ys", 60, "10-K", _SHARES, _YEAR),
    (29, "us-gaap", "StockholdersEquity", "USD", "NULL", 35, "10-Q", "life_cents / 1e3", "true"),
    (30, "ifrs-full", "StockholdersEquity", "USD", "NULL", 35, "10-Q", "life_cents / 1e3 + 7", "n % 2 = 0"),
    (31, "us-gaap", "CashAndCashEquivalentsAtCarryingValue", "USD", "NULL", 35, "10-Q", "cents / 5e2", "true"),
    (32, "us-gaap", "LongTermDebtCurrent", "USD", "NULL", 35, "10-Q", "qty * 7e0", "symbol <> 'EUROPE' AND NOT ends_with(symbol, '3')"),
    (33, "us-gaap", "LongTermDebtNoncurrent", "USD", "NULL", 35, "10-Q", "qty * 90e0", "true"),
    (34, "us-gaap", "ShortTermBorrowings", "USD", "NULL", 35, "10-Q", "qty * 2e0", "n % 2 = 0"),
    (35, "us-gaap", "CommercialPaper", "USD", "NULL", 35, "10-Q", "qty * 3e0", "n % 3 = 0"),
]
VIEWS["fx_facts"] = "\nUNION ALL ".join(
    f"SELECT symbol, '{tax}' AS taxonomy, '{tag}' AS concept, '{unit}' AS unit, CAST({start} AS DATE) AS start, qe AS \"end\", "
    f"CAST(qe + {days} AS DATE) AS filed, '{form}' AS form, concat_ws('-', symbol, n, '{kind}') AS accn, "
    f"CAST({val} AS DOUBLE) AS val, CAST({kind} * 1000 + n AS BIGINT) AS pos FROM fx_quarters WHERE {when}"
    for kind, tax, tag, unit, start, days, form, val, when in _FACTS
)

VIEWS["fx_filings"] = """
SELECT 'C' || o_custkey AS symbol, CAST(o_custkey AS VARCHAR) AS cik, o_custkey,
  lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS accession,
  CASE left(o_orderpriority, 1) WHEN '1' THEN '10-Q' WHEN '2' THEN '10-K' WHEN '3' THEN '8-K' WHEN '4' THEN '6-K' ELSE 'S-1' END
    || CASE WHEN o_orderkey % 10 = 0 THEN '/A' ELSE '' END AS form,
  CAST(o_orderdate AS DATE) AS filed, CAST(date_trunc('quarter', o_orderdate) AS DATE) - 1 AS report_date,
  CASE WHEN left(o_orderpriority, 1) = '4' AND o_orderkey % 3 = 0 THEN 'q-Earnings-' ELSE 'doc' END || o_orderkey || '.htm' AS document,
  CASE WHEN left(o_orderpriority, 1) = '3' THEN CASE WHEN o_orderkey % 2 = 0 THEN '2.02,9.01' ELSE '5.02' END ELSE '' END AS items
FROM orders"""

VIEWS["fx_nation_filings"] = """
SELECT n_name AS symbol, cik, accession, form, filed, report_date, document, items
FROM fx_filings JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

VIEWS["fx_quotes"] = """
SELECT 'U' || user_id AS symbol, ts AS captured_at, event_id, event_type AS kind,
  CASE WHEN event_type <> 'error' THEN round(value * 1000, 2) END AS price, value AS change_percent,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume FROM events"""

VIEWS["fx_catalog"] = """
SELECT 'P' || p_partkey AS symbol,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name,
  lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS cik, p_brand AS alias FROM part"""

VIEWS["fx_concepts"] = """
SELECT * FROM (VALUES
  ('revenue', 'RevenueFromContractWithCustomerExcludingAssessedTax', 0, 'USD'), ('revenue', 'Revenues', 1, 'USD'),
  ('net_income', 'NetIncomeLoss', 0, 'USD'), ('net_income', 'ProfitLoss', 2, 'USD'),
  ('operating_income', 'OperatingIncomeLoss', 0, 'USD'),
  ('operating_cash_flow', 'NetCashProvidedByUsedInOperatingActivities', 0, 'USD'),
  ('capex', 'PaymentsToAcquirePropertyPlantAndEquipment', 0, 'USD'),
  ('eps', 'EarningsPerShareDiluted', 0, 'USD/shares'), ('share_compensation', 'ShareBasedCompensation', 0, 'USD'),
  ('diluted_shares', 'WeightedAverageNumberOfDilutedSharesOutstanding', 0, 'shares'),
  ('equity', 'StockholdersEquity', 0, 'USD'), ('cash', 'CashAndCashEquivalentsAtCarryingValue', 0, 'USD'),
  ('current_long_debt', 'LongTermDebtCurrent', 0, 'USD'), ('noncurrent_long_debt', 'LongTermDebtNoncurrent', 0, 'USD'),
  ('short_borrowings', 'ShortTermBorrowings', 0, 'USD'), ('commercial_paper', 'CommercialPaper', 0, 'USD')
) AS c(metric, concept, priority, unit)"""


def r2(x: str, digits: int = 2) -> str:
    """Half-up rounding, spelled like the Spark side."""
    return f"(floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits})"


VIEWS["v_obs"] = """
SELECT f.*, metric, priority, CASE taxonomy WHEN 'us-gaap' THEN 0 ELSE 1 END AS tax
FROM fx_facts f JOIN fx_concepts c USING (concept, unit)
WHERE regexp_replace(form, '/A$', '') IN ('10-Q', '10-K', '20-F', '40-F', '6-K', '8-K') AND val IS NOT NULL
  AND "end" - start BETWEEN 50 AND 400"""

VIEWS["v_periods"] = f"""
SELECT symbol, metric, start, "end", val, filed, form, accn, concept FROM v_obs WHERE filed <= {AS_OF} AND "end" <= {AS_OF}
QUALIFY row_number() OVER (PARTITION BY symbol, metric, start, "end" ORDER BY filed DESC, priority, tax DESC, pos DESC) = 1"""

VIEWS["v_factor"] = f"""
SELECT o.*, val / coalesce((SELECT product(ratio) FROM fx_splits s WHERE s.symbol = o.symbol AND s.effective_date > o.filed
  AND s.effective_date <= {AS_OF}), 1e0) AS adjusted,
  coalesce((SELECT product(ratio) FROM fx_splits s WHERE s.symbol = o.symbol AND s.effective_date > o.filed
  AND s.effective_date <= {AS_OF}), 1e0) AS factor
FROM v_obs o JOIN fx_known USING (symbol)"""

VIEWS["v_quarters"] = """
SELECT symbol, metric, "end", start, val, filed, form, accn, concept, derived FROM (
  SELECT symbol, metric, "end", start, val, filed, form, accn, concept, false AS derived, 0 AS kind, filed AS k1, start AS k2
  FROM v_periods WHERE "end" - start BETWEEN 60 AND 110
  UNION ALL
  SELECT c.symbol, c.metric, c."end", CAST(p."end" + 1 AS DATE), c.val - p.val, greatest(c.filed, p.filed), c.form, c.accn,
    c.concept, true, 1, NULL, c.start
  FROM v_periods c JOIN v_periods p ON c.symbol = p.symbol AND c.metric = p.metric AND c.start = p.start
    AND c."end" - p."end" BETWEEN 60 AND 110
  QUALIFY row_number() OVER (PARTITION BY c.symbol, c.metric, c.start, c."end" ORDER BY p."end" DESC) = 1)
QUALIFY row_number() OVER (PARTITION BY symbol, metric, "end" ORDER BY kind, k1 DESC, k2) = 1"""

VIEWS["v_ttm"] = """
WITH latest AS (SELECT symbol, metric, max("end") AS last FROM v_periods GROUP BY ALL),
p AS (SELECT * FROM v_periods JOIN latest USING (symbol, metric)),
r1 AS (SELECT symbol, metric, 1 AS rule, start, "end", val, filed FROM p WHERE "end" = last AND "end" - start BETWEEN 330 AND 400
  QUALIFY row_number() OVER (PARTITION BY symbol, metric ORDER BY filed DESC, start) = 1),
r2 AS (SELECT c.symbol, c.metric, 2 AS rule, CAST(q."end" + 1 AS DATE) AS start, c."end", a.val + c.val - q.val AS val,
    greatest(a.filed, c.filed, q.filed) AS filed
  FROM p c JOIN p a ON a.symbol = c.symbol AND a.metric = c.metric AND a."end" - a.start BETWEEN 330 AND 400
    AND c.start - a."end" BETWEEN 0 AND 8
  JOIN p q ON q.symbol = c.symbol AND q.metric = c.metric AND q.start = a.start AND abs(c."end" - q."end" - 365) <= 14
  WHERE c."end" = c.last
  QUALIFY row_number() OVER (PARTITION BY c.symbol, c.metric ORDER BY c.start, a."end", a.start, q.filed DESC, q."end") = 1),
q4 AS (SELECT q.*, row_number() OVER (PARTITION BY symbol, metric ORDER BY "end" DESC) AS rn,
    start - lag("end") OVER (PARTITION BY symbol, metric ORDER BY "end") AS gap, last
  FROM v_quarters q JOIN latest USING (symbol, metric)),
r3 AS (SELECT symbol, metric, 3 AS rule, min(start) AS start, max("end") AS "end",
    any_value(CASE WHEN rn = 4 THEN val END) + any_value(CASE WHEN rn = 3 THEN val END)
      + any_value(CASE WHEN rn = 2 THEN val END) + any_value(CASE WHEN rn = 1 THEN val END) AS val, max(filed) AS filed
  FROM q4 WHERE rn <= 4 GROUP BY symbol, metric
  HAVING count(*) = 4 AND max("end") = any_value(last) AND bool_and(rn = 4 OR gap BETWEEN 0 AND 8)
    AND max("end") - min(start) BETWEEN 330 AND 400)
SELECT * FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)
QUALIFY row_number() OVER (PARTITION BY symbol, metric ORDER BY rule) = 1"""

VIEWS["v_eps_ttm"] = """
WITH latest AS (SELECT symbol, metric, max("end") AS last FROM v_periods WHERE metric = 'eps' GROUP BY ALL),
d AS (SELECT * FROM v_periods WHERE metric = 'eps' AND "end" - start BETWEEN 60 AND 110
  QUALIFY row_number() OVER (PARTITION BY symbol, "end" ORDER BY filed DESC, start DESC) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "end" DESC) AS rn,
  start - lag("end") OVER (PARTITION BY symbol ORDER BY "end") AS gap FROM d JOIN latest USING (symbol, metric))
SELECT symbol, min(start) AS start, max("end") AS "end", max(filed) AS filed,
  any_value(CASE WHEN rn = 4 THEN val END) + any_value(CASE WHEN rn = 3 THEN val END)
    + any_value(CASE WHEN rn = 2 THEN val END) + any_value(CASE WHEN rn = 1 THEN val END) AS val
FROM k WHERE rn <= 4 GROUP BY symbol
HAVING count(*) = 4 AND max("end") = any_value(last) AND bool_and(rn = 4 OR gap = 1) AND max("end") - min(start) BETWEEN 330 AND 400"""

VIEWS["v_timeline"] = f"""
WITH e AS (SELECT * FROM v_factor WHERE metric = 'eps' AND filed <= {AS_OF}),
dates AS (SELECT DISTINCT symbol, filed AS d FROM e),
seen AS (SELECT dates.d, e.* FROM dates JOIN e ON e.symbol = dates.symbol AND e.filed <= d AND e."end" <= d
  QUALIFY row_number() OVER (PARTITION BY e.symbol, d, start, "end" ORDER BY filed DESC, priority, tax DESC, pos DESC) = 1),
last AS (SELECT symbol, d, max("end") AS period_end FROM seen GROUP BY ALL),
q AS (SELECT * FROM seen WHERE "end" - start BETWEEN 60 AND 110
  QUALIFY row_number() OVER (PARTITION BY symbol, d, "end" ORDER BY filed DESC, start DESC) = 1),
k AS (SELECT q.*, row_number() OVER (PARTITION BY symbol, d ORDER BY "end" DESC) AS rn,
  start - lag("end") OVER (PARTITION BY symbol, d ORDER BY "end") AS gap FROM q),
s AS (SELECT symbol, d, max("end") AS last_end, any_value(CASE WHEN rn = 1 THEN accn END) AS accession,
    any_value(CASE WHEN rn = 4 THEN adjusted END) + any_value(CASE WHEN rn = 3 THEN adjusted END)
      + any_value(CASE WHEN rn = 2 THEN adjusted END) + any_value(CASE WHEN rn = 1 THEN adjusted END) AS eps
  FROM k WHERE rn <= 4 GROUP BY symbol, d
  HAVING count(*) = 4 AND bool_and(rn = 4 OR gap = 1) AND max("end") - min(start) BETWEEN 330 AND 400)
SELECT dates.symbol, CAST(dates.d + 1 AS DATE) AS available_on, dates.d AS filed_at, period_end, eps, accession
FROM dates LEFT JOIN last USING (symbol, d) LEFT JOIN s ON s.symbol = dates.symbol AND s.d = dates.d AND last_end = period_end"""

VIEWS["v_clean"] = f"SELECT * FROM fx_prices WHERE close > 0 AND date <= {AS_OF}"

VIEWS["v_states"] = """
SELECT p.symbol, p.date, close AS price, eps, filed_at AS eps_filed_at, period_end AS eps_period_end,
  CASE WHEN eps IS NULL THEN 'missing_eps' WHEN date - period_end > 160 THEN 'stale_eps' WHEN eps <= 0 THEN 'nonpositive_eps'
    ELSE 'valid' END AS state,
  CASE WHEN eps IS NOT NULL AND date - period_end <= 160 AND eps > 0 THEN close / eps END AS pe
FROM v_clean p ASOF LEFT JOIN v_timeline t ON p.symbol = t.symbol AND p.date >= t.available_on"""

VIEWS["v_ends"] = """
SELECT symbol, max(date) AS valuation_date, arg_max_null(pe, date) AS current_pe, arg_max_null(eps, date) AS current_eps,
  max_by(state, date) AS current_state FROM v_states GROUP BY symbol"""

VIEWS["v_windows"] = f"""
WITH h AS (SELECT *, CAST(valuation_date - to_years(years) AS DATE) AS window_start
  FROM v_ends, (SELECT unnest([10, 5, 3, 1]) AS years)),
grid AS (SELECT h.symbol, years, session_date, state, state IN ('valid', 'nonpositive_eps') AS covered
  FROM h JOIN fx_calendar ON session_date BETWEEN window_start AND valuation_date
  LEFT JOIN v_states s ON s.symbol = h.symbol AND s.date = session_date),
runs AS (SELECT *, row_number() OVER (PARTITION BY symbol, years ORDER BY session_date)
    - row_number() OVER (PARTITION BY symbol, years, coalesce(covered, false) ORDER BY session_date) AS island FROM grid),
gaps AS (SELECT symbol, years, max(n) AS max_missing_run FROM (
  SELECT symbol, years, island, count(*) AS n FROM runs WHERE NOT coalesce(covered, false) GROUP BY ALL) GROUP BY ALL),
tally AS (SELECT symbol, years, count(*) AS expected_sessions, count(state) AS priced_sessions,
    count(*) FILTER (NOT coalesce(covered, false)) AS missing_sessions,
    count(*) FILTER (state = 'nonpositive_eps') AS nonpositive_sessions FROM grid GROUP BY ALL),
valid AS (SELECT h.symbol, years, count(pe) AS valid_samples, count(*) FILTER (pe <= current_pe) AS at_or_below
  FROM h LEFT JOIN v_states s ON s.symbol = h.symbol AND date BETWEEN window_start AND valuation_date GROUP BY ALL)
SELECT symbol, years, window_start, valuation_date, expected_sessions, priced_sessions, valid_samples, missing_sessions,
  nonpositive_sessions, {r2("(expected_sessions - missing_sessions) / expected_sessions * 100", 3)} AS coverage_percent,
  coalesce(max_missing_run, 0) AS max_missing_run,
  (expected_sessions - missing_sessions) / expected_sessions >= 0.995e0 AND expected_sessions - priced_sessions <= 2
    AND coalesce(max_missing_run, 0) <= 3 AND valid_samples >= 200 * years AS qualified,
  CASE WHEN qualified THEN {r2("1e2 * at_or_below / valid_samples")} END AS percentile
FROM h JOIN tally USING (symbol, years) LEFT JOIN gaps USING (symbol, years) JOIN valid USING (symbol, years)"""

VIEWS["v_selected"] = """
SELECT symbol, any_value(valuation_date) AS valuation_date, max(CASE WHEN qualified THEN years END) AS years,
  max_by(percentile, CASE WHEN qualified THEN years END) AS percentile, max(CASE WHEN years = 10 THEN percentile END) AS percentile10y
FROM v_windows GROUP BY symbol"""

VIEWS["v_history"] = """
SELECT s.* FROM v_states s JOIN v_selected w USING (symbol)
WHERE state = 'valid' AND date >= CAST(valuation_date - to_years(coalesce(years, 10)) AS DATE)"""

VIEWS["v_continuity"] = f"""
SELECT * EXCLUDE (b, a), b AS price_before, a AS price_after, b / a AS price_ratio,
  CASE WHEN b / a BETWEEN 0.5e0 AND 2 THEN 'passed' ELSE 'rejected' END AS status FROM (
  SELECT s.symbol, effective_date, ratio AS split_ratio, max_by(close, date) FILTER (date < effective_date) AS b,
    min_by(close, date) FILTER (date >= effective_date) AS a
  FROM fx_splits s JOIN v_clean p USING (symbol) WHERE effective_date <= {AS_OF} GROUP BY ALL)
WHERE a IS NOT NULL AND b IS NOT NULL"""

VIEWS["v_summary"] = f"""
WITH s AS (SELECT e.*, w.years, w.percentile AS pct, w.percentile10y AS pct10, price,
    eps_filed_at, eps_period_end,
    (SELECT count(*) FROM fx_calendar WHERE session_date > e.valuation_date AND close_ts <= TIMESTAMP '2001-11-05 00:00:00') AS lag,
    CASE WHEN NOT EXISTS (FROM fx_known k WHERE k.symbol = e.symbol) THEN 'policy_unknown'
      WHEN EXISTS (FROM v_continuity c WHERE c.symbol = e.symbol AND c.status = 'rejected') THEN 'split_discontinuity'
      WHEN current_state <> 'valid' THEN 'earnings_not_meaningful' END AS reason,
    a.* EXCLUDE (symbol)
  FROM v_ends e LEFT JOIN v_selected w USING (symbol) JOIN v_states t ON t.symbol = e.symbol AND t.date = e.valuation_date
  JOIN (SELECT symbol, count(*) FILTER (state IN ('missing_eps', 'stale_eps')) AS missing_days,
          count(*) FILTER (state = 'nonpositive_eps') AS loss_days, min(date) FILTER (state = 'valid') AS first_sample
        FROM v_states GROUP BY symbol) a ON a.symbol = e.symbol),
n AS (SELECT symbol, count(*) AS sample_count, min(date) AS history_start, max(date) AS history_end FROM v_history GROUP BY symbol)
SELECT symbol, 4 AS algorithm_version,
  CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN lag > 1 THEN 'stale' WHEN years = 10 THEN 'qualified'
    WHEN years IS NOT NULL THEN 'limited' ELSE 'current_only' END AS status,
  reason, reason IS NULL AND lag <= 1 AS current_pe_qualified, 'daily' AS frequency, valuation_date AS as_of, price,
  CASE WHEN reason IS NULL THEN current_pe END AS pe, CASE WHEN reason IS NULL THEN current_eps END AS eps_ttm,
  CASE WHEN reason IS NULL THEN eps_filed_at END AS eps_filed_at, CASE WHEN reason IS NULL THEN eps_period_end END AS eps_period_end,
  CASE WHEN reason IS NULL THEN years END AS horizon_years,
  CASE WHEN reason IS NULL AND lag <= 1 THEN pct END AS percentile, CASE WHEN reason IS NULL AND lag <= 1 THEN pct10 END AS percentile10y,
  CASE WHEN reason IS NULL THEN sample_count END AS sample_count, CASE WHEN reason IS NULL THEN history_start END AS history_start,
  CASE WHEN reason IS NULL THEN history_end END AS history_end, CASE WHEN reason IS NULL THEN 1e2 / current_pe END AS earnings_yield_percent,
  lag AS lag_sessions, CASE WHEN reason IS NULL THEN {r2("(valuation_date - first_sample) / 365.25e0")} END AS coverage_years,
  missing_days AS missing_earnings_days, loss_days AS nonpositive_earnings_days
FROM s LEFT JOIN n USING (symbol)"""


VIEWS["v_basis"] = """
WITH rev AS (SELECT * FROM v_periods WHERE metric = 'revenue'),
l AS (SELECT symbol, max("end") AS period_end FROM rev GROUP BY symbol),
prior AS (SELECT symbol, max("end") AS prior_end FROM rev JOIN l USING (symbol) WHERE period_end - "end" BETWEEN 60 AND 110 GROUP BY symbol),
whole AS (SELECT rev.* FROM rev JOIN l ON rev.symbol = l.symbol AND rev."end" = l.period_end
  QUALIFY row_number() OVER (PARTITION BY rev.symbol ORDER BY start) = 1)
SELECT l.symbol, period_end, prior_end, coalesce(q.start, w.start) AS period_start,
  CASE WHEN q.symbol IS NOT NULL THEN 'quarter' WHEN period_end - w.start >= 330 THEN 'annual' ELSE 'ytd' END AS period_type,
  CASE WHEN q.symbol IS NOT NULL THEN q.form ELSE w.form END AS form, CASE WHEN q.symbol IS NOT NULL THEN q.accn ELSE w.accn END AS accession
FROM l JOIN whole w USING (symbol) LEFT JOIN prior USING (symbol)
LEFT JOIN v_quarters q ON q.symbol = l.symbol AND q.metric = 'revenue' AND q."end" = period_end"""

_METRICS = ("revenue", "net_income", "operating_income", "operating_cash_flow", "capex", "eps")


def _matched(metric: str, column: str = "val") -> str:
    key = f"x.symbol = b.symbol AND x.metric = '{metric}' AND x.\"end\" = period_end AND x.start = period_start"
    return (f"CASE WHEN period_type = 'quarter' THEN (SELECT {column} FROM v_quarters x WHERE {key}) "
            f"ELSE (SELECT {column} FROM v_periods x WHERE {key}) END")


def _ttm(metric: str) -> str:
    view = "v_eps_ttm x WHERE" if metric == "eps" else f"v_ttm x WHERE x.metric = '{metric}' AND"
    return f"(SELECT val FROM {view} x.symbol = b.symbol AND x.\"end\" = period_end)"


def _prior(metric: str) -> str:
    ends = f"(SELECT max(\"end\") FROM v_periods e WHERE e.symbol = b.symbol AND e.metric = '{metric}' AND abs(period_end - e.\"end\" - 365) <= 14)"
    return (f"CASE WHEN period_type = 'quarter' THEN (SELECT val FROM v_quarters x WHERE x.symbol = b.symbol AND x.metric = '{metric}' AND x.\"end\" = {ends}) "
            f"WHEN period_type = 'annual' THEN (SELECT arg_min(val, start) FROM v_periods x WHERE x.symbol = b.symbol AND x.metric = '{metric}' AND x.\"end\" - x.start >= 330 AND x.\"end\" = {ends}) END")


def _then(metric: str, column: str) -> str:
    return f"(SELECT {column} FROM v_quarters x WHERE x.symbol = b.symbol AND x.metric = '{metric}' AND x.\"end\" = prior_end)"


_YOY = "CASE WHEN {0}_then > 0 THEN " + r2("1e2 * ({0} / {0}_then - 1e0)") + " END AS {0}_yoy"

VIEWS["v_snapshot"] = f"""
WITH w AS (SELECT b.*, {', '.join(f'{_matched(m)} AS {m}' for m in _METRICS)},
  greatest({', '.join(_matched(m, 'filed') for m in _METRICS)}) AS filed_at,
  {', '.join(f'{_ttm(m)} AS {m}_ttm' for m in _METRICS)}, {_matched('capex', 'concept')} AS capex_concept,
  {_prior('revenue')} AS revenue_then, {_prior('net_income')} AS net_income_then,
  {_then('operating_cash_flow', 'val')} AS ocf_then, {_then('capex', 'val')} AS capex_then,
  {_then('operating_cash_flow', 'start')} AS ocf_start, {_then('capex', 'start')} AS capex_start
  FROM v_basis b),
d AS (SELECT *, CASE WHEN period_type = 'quarter' AND ocf_start = capex_start THEN operating_cash_flow - ocf_then + (capex - capex) END AS cash_delta,
  CASE WHEN period_type = 'quarter' AND ocf_start = capex_start AND operating_cash_flow IS NOT NULL THEN capex - capex_then END AS capex_delta FROM w)
SELECT symbol, 3 AS schema_version, 'USD' AS currency, period_type, period_start, period_end, filed_at, form, accession,
  revenue, net_income, operating_income, operating_cash_flow, capex, operating_cash_flow - capex AS free_cash_flow,
  {', '.join(f'{m}_ttm' for m in _METRICS)}, operating_cash_flow_ttm - capex_ttm AS free_cash_flow_ttm,
  {_YOY.format('revenue')}, {_YOY.format('net_income')}, cash_delta, capex_delta, cash_delta - capex_delta AS fcf_delta,
  CASE WHEN capex_delta > 0 THEN {r2('cash_delta / capex_delta', 4)} END AS marginal_coverage, capex_concept, period_type = 'quarter' AS quarterly
FROM d"""

VIEWS["v_annual_history"] = """
WITH r AS (SELECT symbol, start, "end", filed, accn FROM v_periods WHERE metric = 'revenue' AND "end" - start BETWEEN 330 AND 400
  QUALIFY row_number() OVER (PARTITION BY symbol, "end" ORDER BY start DESC) = 1),
s AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "end" DESC) <= 6)
SELECT s.symbol, s.start AS period_start, s."end" AS period_end, s.filed AS filed_at, s.accn AS accession,
  max(val) FILTER (metric = 'revenue') AS revenue, max(val) FILTER (metric = 'net_income') AS net_income,
  max(val) FILTER (metric = 'operating_income') AS operating_income, max(val) FILTER (metric = 'operating_cash_flow') AS operating_cash_flow,
  max(val) FILTER (metric = 'capex') AS capex, max(val) FILTER (metric = 'share_compensation') AS share_compensation,
  max(val) FILTER (metric = 'operating_cash_flow') - max(val) FILTER (metric = 'capex') AS free_cash_flow
FROM s JOIN v_periods p ON p.symbol = s.symbol AND p.start = s.start AND p."end" = s."end" GROUP BY ALL"""

VIEWS["v_annual_summary"] = """
WITH h AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS rn,
  period_end - lag(period_end) OVER (PARTITION BY symbol ORDER BY period_end) AS step FROM v_annual_history),
g AS (SELECT symbol, count(*) AS n, bool_and(coalesce(step BETWEEN 330 AND 400, true)) AS history_contiguous,
  arg_min_null(revenue, period_end) AS a, arg_max_null(revenue, period_end) AS b, max(period_end) - min(period_end) AS span,
  count(free_cash_flow) FILTER (rn <= 5) AS cash_years_known, count(*) FILTER (rn <= 5 AND free_cash_flow > 0) AS cash_years_positive,
  count(net_income) FILTER (rn <= 5) AS profit_years_known, count(*) FILTER (rn <= 5 AND net_income > 0) AS profit_years_positive
  FROM h GROUP BY symbol)
SELECT symbol, history_contiguous, CASE WHEN n = 6 AND history_contiguous AND a > 0 AND b > 0
    THEN 1e2 * (pow(b / a, 1e0 / (span / 365.25e0)) - 1e0) END AS revenue_cagr5y,
  cash_years_known, cash_years_positive, profit_years_known, profit_years_positive FROM g"""

VIEWS["v_instants"] = f"""
SELECT f.symbol, metric, f."end", val, filed, accn, concept FROM fx_facts f JOIN fx_concepts c USING (concept, unit)
WHERE start IS NULL AND val IS NOT NULL AND filed <= {AS_OF}
QUALIFY row_number() OVER (PARTITION BY f.symbol, metric, f."end" ORDER BY filed DESC, priority,
  CASE taxonomy WHEN 'us-gaap' THEN 0 ELSE 1 END, pos) = 1"""

VIEWS["v_prior_equity"] = """
SELECT i.symbol, i.val AS prior_equity FROM v_instants i JOIN v_snapshot s USING (symbol)
WHERE metric = 'equity' AND i."end" = (SELECT max("end") FROM fx_facts f WHERE f.symbol = s.symbol AND concept = 'StockholdersEquity'
  AND abs(s.period_end - f."end" - 365) <= 14)"""

VIEWS["v_shares"] = """
SELECT s.symbol, coalesce(q.val, CASE WHEN period_type = 'quarter' THEN y.val END) AS diluted_shares,
  coalesce(q.start, CASE WHEN period_type = 'quarter' THEN y.start END) || ' / ' || period_end AS shares_period
FROM v_snapshot s LEFT JOIN v_quarters q ON q.symbol = s.symbol AND q.metric = 'diluted_shares' AND q."end" = period_end AND NOT q.derived
LEFT JOIN (SELECT * FROM v_periods WHERE metric = 'diluted_shares' AND "end" - start BETWEEN 330 AND 400) y
  ON y.symbol = s.symbol AND y."end" = period_end
WHERE q.val IS NOT NULL OR (period_type = 'quarter' AND y.val IS NOT NULL)"""

VIEWS["v_quality"] = """
WITH bal AS (SELECT i.symbol, max(val) FILTER (metric = 'equity') AS equity, max(val) FILTER (metric = 'cash') AS cash,
  max(val) FILTER (metric = 'current_long_debt') AS cur, max(val) FILTER (metric = 'noncurrent_long_debt') AS noncur,
  max(val) FILTER (metric = 'short_borrowings') AS short_borrowings, max(val) FILTER (metric = 'commercial_paper') AS commercial_paper
  FROM v_instants i JOIN v_snapshot s ON s.symbol = i.symbol AND s.period_end = i."end" GROUP BY i.symbol)
SELECT s.symbol, 1 AS version, s.currency, s.period_end, coalesce(a.history_contiguous, true) AS history_contiguous, a.revenue_cagr5y,
  coalesce(a.cash_years_known, 0) AS cash_years_known, coalesce(a.cash_years_positive, 0) AS cash_years_positive,
  coalesce(a.profit_years_known, 0) AS profit_years_known, coalesce(a.profit_years_positive, 0) AS profit_years_positive,
  CASE WHEN equity > 0 AND prior_equity > 0 THEN 1e2 * net_income_ttm / ((equity + prior_equity) / 2) END AS roe_ttm, equity,
  cur + noncur AS long_debt, CASE WHEN operating_cash_flow_ttm > 0 THEN (cur + noncur) / operating_cash_flow_ttm END AS long_debt_to_ocf,
  cash, short_borrowings, commercial_paper, t.val AS share_compensation_ttm, diluted_shares, shares_period,
  CASE WHEN diluted_shares > 0 THEN (free_cash_flow_ttm - t.val) / diluted_shares END AS cash_per_share_proxy
FROM v_snapshot s LEFT JOIN v_annual_summary a USING (symbol) LEFT JOIN bal USING (symbol) LEFT JOIN v_prior_equity USING (symbol)
LEFT JOIN v_ttm t ON t.symbol = s.symbol AND t.metric = 'share_compensation' AND t."end" = s.period_end
LEFT JOIN v_shares h ON h.symbol = s.symbol"""


VIEWS["v_relevant"] = """
SELECT *, regexp_replace(form, '/A$', '') AS base FROM fx_filings WHERE regexp_replace(form, '/A$', '') IN ('10-Q', '10-K', '20-F', '40-F')
  OR (regexp_replace(form, '/A$', '') = '8-K' AND contains(items, '2.02'))
  OR (regexp_replace(form, '/A$', '') = '6-K' AND regexp_matches(document, 'fsx|earn|result|quarter', 'i'))"""
VIEWS["v_nation_relevant"] = VIEWS["v_relevant"].replace("fx_filings", "fx_nation_filings")

VIEWS["v_pending"] = """
WITH l AS (SELECT * FROM v_nation_relevant QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY filed DESC, accession DESC) = 1)
SELECT l.symbol, accession, l.form, filed, report_date, period_end, CASE WHEN period_end IS NULL THEN true
  WHEN base = '8-K' OR ends_with(l.form, '/A') THEN filed > filed_at ELSE report_date > period_end END AS pending
FROM l LEFT JOIN (SELECT symbol, period_end, filed_at FROM v_snapshot) s USING (symbol)"""

VIEWS["v_companies"] = f"""
SELECT s.* EXCLUDE (form, accession), v.algorithm_version, v.status, v.current_pe_qualified, v.frequency, v.price, v.pe,
  v.eps_period_end, v.horizon_years, v.percentile, v.percentile10y, q.version AS q_version, q.currency AS q_currency,
  q.period_end AS q_period_end, q.history_contiguous AS q_history_contiguous, q.revenue_cagr5y AS q_revenue_cagr5y,
  q.cash_years_known AS q_cash_years_known, q.cash_years_positive AS q_cash_years_positive, q.roe_ttm AS q_roe_ttm,
  q.long_debt_to_ocf AS q_long_debt_to_ocf, q.diluted_shares AS q_diluted_shares, q.cash_per_share_proxy AS q_cash_per_share_proxy,
  coalesce(p.pending, false) AS pending, {AS_OF} - s.period_end BETWEEN 0 AND 160 AND NOT coalesce(p.pending, false) AS fresh,
  coalesce(CASE WHEN s.operating_income <= 0 THEN s.net_income > 0 ELSE s.net_income > s.operating_income * 1.5 END, false) AS abnormal,
  coalesce(s.operating_income > 0 AND s.net_income > s.operating_income * 1.5, false) AS effect,
  coalesce(v.current_pe_qualified AND v.pe > 0, false) AS pe_valid,
  CASE WHEN v.current_pe_qualified AND v.status IN ('qualified', 'limited') THEN v.percentile END AS eligible
FROM v_snapshot s LEFT JOIN v_summary v USING (symbol) LEFT JOIN v_quality q USING (symbol) LEFT JOIN v_pending p USING (symbol)"""

_RATIO = "CASE WHEN {1} > 0 THEN {0} / {1} * {2} END"
_MARKS = [
    ("growth", "revenue_yoy", "%", "value > 0", None), ("margin", _RATIO.format("operating_income", "revenue", "1e2"), "%", "value >= 15", None),
    ("conversion", _RATIO.format("operating_cash_flow", "net_income", "1e2"), "%", "value >= 100", None),
    ("cash", _RATIO.format("free_cash_flow", "revenue", "1e2"), "%", "value > 0", None),
    ("reinvestment", _RATIO.format("capex", "operating_cash_flow", "1e2"), "%", "value <= 100", None),
    ("yield", "CASE WHEN pe_valid THEN 1e2 / pe END", "%", "true", "'unknown'"),
    ("profit_quality", _RATIO.format("net_income", "operating_income", "1e0"), "x", "true", "'caution'"),
    ("cagr", "q_revenue_cagr5y", "%", "value > 0", None),
    ("consistency", "CASE WHEN q_cash_years_known = 5 AND q_history_contiguous THEN CAST(q_cash_years_positive AS DOUBLE) END", "years", "value = 5", None),
    ("roe", "q_roe_ttm", "%", "value BETWEEN 15 AND 80 AND NOT abnormal", None),
    ("debt", "q_long_debt_to_ocf", "x", "true", "CASE WHEN fresh AND value > 3 THEN 'caution' ELSE 'unknown' END"),
]
VIEWS["v_metrics"] = "\nUNION ALL ".join(
    f"SELECT symbol, fresh, pe_valid, '{key}' AS metric, value, '{unit}' AS unit, "
    + (fixed or f"CASE WHEN NOT fresh OR value IS NULL THEN 'unknown' WHEN {support} THEN 'support' ELSE 'caution' END")
    + f" AS state FROM (SELECT *, {value} AS value FROM v_companies)" + (" WHERE fresh AND abnormal" if key == "profit_quality" else "")
    for key, value, unit, support, fixed in _MARKS
)

VIEWS["fx_assumptions"] = """
SELECT 'C' || c_custkey AS symbol, c_acctbal / 1e2 AS cash_per_share, CAST(c_custkey % 9 - 2 AS DOUBLE) AS growth,
  CAST(8 + c_custkey % 5 AS DOUBLE) AS required_return, CASE WHEN c_custkey % 50 = 0 THEN 20e0 ELSE CAST(c_custkey % 4 AS DOUBLE) END AS terminal_growth,
  CAST(c_custkey % 3 * 20 AS DOUBLE) AS safety_margin, CAST(5 + c_custkey % 8 AS DOUBLE) + CASE WHEN c_custkey % 77 = 0 THEN 0.5e0 ELSE 0e0 END AS years,
  CASE WHEN c_custkey % 10 <> 3 THEN c_acctbal / 4e0 END AS price FROM customer"""

VIEWS["v_valued"] = """
WITH u AS (SELECT *, cash_per_share > 0 AND growth > -100 AND required_return > 0 AND terminal_growth > -100 AND required_return > terminal_growth
    AND safety_margin >= 0 AND safety_margin < 100 AND years = floor(years) AND years BETWEEN 1 AND 20 AS ok FROM fx_assumptions),
p AS (SELECT *, CASE WHEN ok THEN list_sum(list_transform(generate_series(1, CAST(floor(years) AS BIGINT)),
    lambda y: cash_per_share * pow(1 + growth / 1e2, y) / pow(1 + required_return / 1e2, y))) END AS present_cash,
  CASE WHEN ok THEN cash_per_share * pow(1 + growth / 1e2, years) * (1 + terminal_growth / 1e2) / (required_return / 1e2 - terminal_growth / 1e2)
    / pow(1 + required_return / 1e2, years) END AS present_terminal FROM u)
SELECT symbol, growth, required_return, safety_margin, present_cash, present_terminal, present_cash + present_terminal AS value,
  (present_cash + present_terminal) * (1 - safety_margin / 1e2) AS entry_price,
  CASE WHEN price > 0 THEN (1 - price / (present_cash + present_terminal)) * 100 END AS margin_at_price,
  present_terminal / (present_cash + present_terminal) * 100 AS terminal_weight FROM p"""

VIEWS["fx_projections"] = """
SELECT 'C' || c_custkey AS symbol, c_acctbal * 1e6 AS annual_revenue, CASE WHEN c_custkey % 20 = 0 THEN 'TWD' ELSE 'USD' END AS currency,
  CAST(c_custkey % 30 AS DOUBLE) AS net_margin, CAST(10 + c_custkey % 25 AS DOUBLE) AS target_pe, CAST(1000000 + c_custkey AS DOUBLE) AS diluted_shares,
  CAST(c_custkey % 40 - 5 AS DOUBLE) AS first_growth, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey % 15 AS DOUBLE) END AS second_growth,
  CAST(c_custkey % 5 - 2 AS DOUBLE) AS annual_share_change, c_custkey % 3 AS years, CASE WHEN c_custkey % 10 <> 3 THEN 10e0 + c_custkey % 90 END AS price FROM customer"""


VIEWS["fx_grid"] = """
SELECT * REPLACE (growth + g AS growth, required_return + r AS required_return), g AS growth_offset, r AS return_offset
FROM fx_assumptions, (SELECT unnest([-3e0, 0e0, 3e0]) AS g), (SELECT unnest([-1e0, 0e0, 1e0]) AS r)"""
VIEWS["v_grid_valued"] = VIEWS["v_valued"].replace("fx_assumptions", "fx_grid").replace("SELECT symbol, growth,", "SELECT symbol, growth_offset, return_offset, growth,")

_T = VIEWS["v_timeline"]
VIEWS["v_components"] = _T[:_T.index("SELECT dates.symbol")] + """
SELECT k.symbol, k.d AS event_id, k.start, k."end", k.filed AS filed_at, k.val AS reported_eps, k.factor AS split_adjustment, k.adjusted AS eps,
  k.accn AS accession FROM k JOIN s ON s.symbol = k.symbol AND s.d = k.d JOIN last ON last.symbol = k.symbol AND last.d = k.d AND last_end = period_end
WHERE rn <= 4"""


def _strip(text: str, *patterns: tuple[str, str]) -> str:
    for pattern, replacement in patterns:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return text


def _unescape(text: str) -> str:
    for name, plain in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"),
                        ("&middot;", "'·'"), ("&copy;", "'©'"), ("&mdash;", "'—'"), ("&ndash;", "'–'"), ("&hellip;", "'…'"), ("&amp;", "'&'")):
        text = f"replace({text}, '{name}', {plain})"
    return text


_BLOCKS = ("address|article|aside|blockquote|div|figcaption|figure|footer|h1|h2|h3|h4|h5|h6|header|li|main|ol|p|pre|section|table|td|th|tr|ul")
_BARE = _strip(
    "html", *[(rf"(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>".replace("\\\\", "\\"), "") for tag in ("script", "style", "noscript", "template")],
    (r"(?s)<!--.*?-->|<![^>]*>", ""), (rf"(?i)<br\b[^>]*>|<img\b[^>]*>|</({_BLOCKS})\s*>", "\n"), ("<[^>]*>", ""))
_PLAIN = _strip(f"replace(replace({_unescape(_BARE)}, chr(160), ' '), chr(8203), '')", (r"\r\n?", "\n"), (r"[\t\f\v ]+", " "), (r" ?\n ?", "\n"),
                (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""))
VIEWS["v_page_text"] = f"SELECT page_id, trim({_PLAIN}) AS text FROM pages"


for _name in ("v_periods", "v_quarters", "v_ttm"):
    VIEWS[f"{_name}_mid"] = VIEWS[_name].replace(AS_OF, "DATE '2000-03-15'").replace("v_periods", "v_periods_mid").replace("v_quarters", "v_quarters_mid")


def day(name: str, alias: str | None = None) -> str:
    """A date column as ISO text."""
    return f'CAST("{name}" AS VARCHAR) AS "{alias or name}"'


def complete(body: str) -> str:
    """The statement with every view it needs as a common table expression."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b(?:fx|v)_\w+", text)):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    views = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in needed)
    body = body.strip()
    if body.startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text of ASCII characters."""
    shifts = "lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    step = f"list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {shifts})"
    symbols = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {symbols}), lambda c, b: {step}), 4294967295)"
