"""Feeds and events: sources, cleaning, filings, quotes, directory search, keyed state and streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import catalog_index, directory, filings, matching, quotes
from plumbline.plans import fixtures as fx
from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.plans.sql_views import crc32_sql, day
from plumbline.session import input_tasks, shared_folder
from plumbline.sources import file_index, readers, sinks
from plumbline.sources.versions import Table
from plumbline.streaming import deadlines, streams

_SPAN = f"{day('start')}, {day('end')}, {day('filed')}"


# sources -----------------------------------------------------------------------------------------------------------

@query("facts_documents", "S1", f"""
SELECT symbol, taxonomy, concept, unit, {_SPAN}, form, accn, val FROM fx_facts WHERE NOT (start IS NOT NULL AND concept = 'Revenues' AND form = 'S-1')""")
def facts_documents(spark, sf):
    facts = fx.facts(spark, sf)
    bad = (F.col("concept") == "Revenues") & (F.col("form") == "S-1")
    item = F.struct(
        F.when(bad, F.lit("1999-13-45")).otherwise(F.col("start").cast("string")).alias("start"), F.col("end").cast("string").alias("end"),
        F.col("filed").cast("string").alias("filed"), "form", "accn", "val")
    body = F.create_map("taxonomy", F.create_map("concept", F.struct(F.create_map("unit", F.array(item)).alias("units"))))
    documents = facts.select(F.to_json(F.struct("symbol", body.alias("facts"))).alias("document"))
    return readers.facts_from_json(documents).drop("pos")


@query("prices_feed", "S2", f"SELECT symbol, {day('date')}, close FROM fx_prices")
def prices_feed(spark, sf):
    prices = fx.prices(spark, sf)
    text = F.concat(F.lit("$"), F.format_number("close", 4))
    rows = prices.select("symbol", F.date_format("date", "MM/dd/yyyy").alias("date"), text.alias("close"), F.lit(2).cast("long").alias("pos"))
    older = rows.withColumns({"close": F.lit("$1.00"), "pos": F.lit(1).cast("long")})
    broken = rows.withColumn("date", F.lit("13/45/1999"))
    return readers.parse_prices(rows.unionByName(older).unionByName(broken))


def _payloads(spark, sf):
    q = fx.quotes(spark, sf)
    item = F.struct("symbol", "last", "change_pct", F.lit(None).cast("string").alias("open"), F.lit("unch").alias("high"),
                    F.lit("1,234.5").alias("low"), "volume", F.lit(None).cast("string").alias("last_timedate"), F.lit(None).cast("string").alias("last_time"))
    one = F.to_json(item)
    text = F.when(F.col("event_id") % 2 == 0, one).otherwise(F.concat(F.lit("["), one, F.lit("]")))
    return q.select(F.col("captured_at").cast("string").alias("captured_at"), text.alias("quotes"))


@query("quotes_feed", "S3 P1 P20", """
SELECT symbol, strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at, price, change_percent, CAST(NULL AS DOUBLE) AS open, CAST(NULL AS DOUBLE) AS high,
  1234.5e0 AS low, volume FROM fx_quotes""")
def quotes_feed(spark, sf):
    return readers.parse_quotes(_payloads(spark, sf)).drop("as_of")


def _filing_payloads(spark, sf):
    rows = fx.filings(spark, sf)
    short = F.when(F.col("items") == "", F.array().cast("array<string>")).otherwise(F.array("items"))
    return rows.select(
        "symbol", "cik", F.array("accession").alias("accessionNumber"), F.array("form").alias("form"), F.array(F.col("filed").cast("string")).alias("filingDate"),
        F.array(F.col("report_date").cast("string")).alias("reportDate"), F.array("document").alias("primaryDocument"), short.alias("items"), "filed")


_FILING = f"symbol, cik, accession, form, {day('filed')}, {day('report_date')}, document, items"


@query("filings_feed", "S4", f"SELECT {_FILING} FROM fx_filings")
def filings_feed(spark, sf):
    return readers.parse_filings(_filing_payloads(spark, sf))


@query("filing_archive", "S5", f"SELECT {_FILING} FROM fx_filings WHERE filed >= DATE '1997-01-01'")
def filing_archive(spark, sf):
    rows = _filing_payloads(spark, sf)
    recent = rows.where("filed >= date'2000-01-01'")
    shards = rows.where("filed < date'2000-01-01'").withColumn("filing_to", F.concat(F.year("filed").cast("string"), F.lit("-12-31")))
    return readers.filing_archive(recent, shards, "1997-06-01")


@query("catalog_feed", "S6 P18", """
SELECT symbol, name, cik, 'US' AS exchange, name AS short FROM fx_catalog WHERE CAST(cik AS BIGINT) % 9 <> 0""")
def catalog_feed(spark, sf):
    key = F.col("p_partkey")
    entry = F.struct(
        F.concat(F.lit("p"), key.cast("string")).alias("ticker"), F.when(key % 9 == 0, "").otherwise(F.upper("p_name")).alias("title"),
        key.cast("string").alias("cik_str"))
    text = F.when(key % 2 == 0, F.to_json(F.array(entry))).otherwise(F.to_json(F.create_map(F.lit("0"), entry)))
    rows = readers.parse_catalog(fx.table(spark, sf, "part").select(text.alias("payload")))
    return rows.withColumn("short", S.short_name(F.concat("name", F.lit(", Inc.")), 24))


@query("supplements_feed", "S7", """
SELECT symbol, CAST(qs AS VARCHAR) AS start, CAST(qe AS VARCHAR) AS "end", income / 1e4 AS val FROM fx_quarters""")
def supplements_feed(spark, sf):
    def item(value):
        return F.struct(F.col("qs").cast("string").alias("start"), F.col("qe").cast("string").alias("end"), F.date_add("qe", 30).cast("string").alias("filed"),
                        F.lit("8-K").alias("form"), F.lit("s").alias("accn"), value.cast("string").alias("val"))

    files = fx.quarters(spark, sf).select("symbol", F.array(item(F.lit(-1.0)), item(F.col("income") / F.lit(10000.0))).alias("quarters"))
    return readers.parse_supplements(files).select("symbol", "start", "end", "val")


@query("report_pages", "S8", "SELECT page_id, url, length(html) AS characters FROM pages")
def report_pages(spark, sf):
    return readers.read_reports(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("characters"))


def _files(documents, name, pretty, tasks):
    """Write (symbol, document) rows as files: one document per line, and where `pretty` one per file, printed over many lines.

    Every seventh line document is followed by a line that is cut off. The files of one document each are dealt to `tasks` tasks,
    each with a folder of its own: they are written and listed side by side, and committed by one rename per folder."""
    folder = shared_folder(documents.sparkSession, name)
    cut = F.when(F.crc32("symbol") % 7 == 0, F.array("document", F.substring("document", 1, 25))).otherwise(F.array("document"))
    documents.where(~F.expr(pretty)).select(F.explode(cut).alias("value")).write.text(f"{folder}/lines")
    spaced = F.replace(F.replace("document", F.lit("{"), F.lit("{\n")), F.lit(","), F.lit(",\n "))
    single = documents.where(pretty).select("symbol", spaced.alias("value")).repartition(tasks, "symbol")
    single.select(F.spark_partition_id().alias("share"), "value").write.partitionBy("share").option("maxRecordsPerFile", 1).text(f"{folder}/documents")
    return folder


def _fact_documents(spark, sf):
    """One document per company, as the provider sends it: taxonomies, concepts, units and their facts, all in maps."""
    facts = fx.facts(spark, sf)
    item = F.struct("pos", F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in ("start", "end", "filed", "form", "accn", "val")))).alias("text"))

    def level(rows, keys, key):
        entries = F.array_sort(F.collect_list(F.concat(F.lit('"'), key, F.lit('":'), "text")))
        return rows.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("text"))

    items = facts.groupBy("symbol", "taxonomy", "concept", "unit").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = items.withColumn("text", F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["text"]), ","), F.lit("]"))).drop("items")
    rows = level(rows, ["symbol", "taxonomy", "concept"], "unit").withColumn("text", F.concat(F.lit('{"units":'), "text", F.lit("}")))
    rows = level(level(rows, ["symbol", "taxonomy"], "concept"), ["symbol"], "taxonomy")
    return rows.select("symbol", F.concat(F.lit('{"cik":"'), F.crc32("symbol").cast("string"), F.lit('","facts":'), "text", F.lit("}")).alias("document"))


_PRETTY = "length(symbol) < 12"
_CIKS = "SELECT DISTINCT symbol FROM fx_entities"


@query("facts_files", "S1", f"""
SELECT symbol, taxonomy, concept, unit, {_SPAN}, form, accn, val,
  row_number() OVER (PARTITION BY symbol, taxonomy, concept, unit ORDER BY pos) - 1 AS pos FROM fx_facts""")
def facts_files(spark, sf):
    """Company facts written as files of both kinds and read back: the company by its cik, the position inside its list."""
    documents = _fact_documents(spark, sf)
    path = _files(documents, "facts", _PRETTY, input_tasks(spark, sf))
    return readers.read_company_facts(spark, path, documents.select(F.crc32("symbol").cast("string").alias("cik"), "symbol"))


def _price_documents(spark, sf):
    """One response per symbol, with all its closing prices as text."""
    row = F.struct(F.date_format("date", "MM/dd/yyyy").alias("date"), F.format_string("$%.4f", "close").alias("close"))
    rows = fx.prices(spark, sf).groupBy("symbol").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    data = F.struct("symbol", F.struct("rows").alias("tradesTable"))
    return rows.select("symbol", F.to_json(F.struct(data.alias("data"))).alias("document"))


@query("price_files", "S2", f"SELECT upper(symbol) AS symbol, {day('date')}, close FROM fx_prices")
def price_files(spark, sf):
    """Price responses written as files of both kinds and read back."""
    return readers.read_prices(spark, _files(_price_documents(spark, sf), "prices", _PRETTY, input_tasks(spark, sf)))


@query("bad_price_records", "S2", f"""
SELECT count(*) AS records, 25 * count(*) AS characters FROM ({_CIKS}) WHERE length(symbol) >= 12 AND {crc32_sql("symbol")} % 7 = 0
  AND symbol IN (SELECT symbol FROM fx_prices)""")
def bad_price_records(spark, sf):
    """Records that do not parse, as the side table holds them."""
    path = _files(_price_documents(spark, sf), "prices", _PRETTY, input_tasks(spark, sf))
    bad = readers.bad_records(readers.json_documents(spark, path, readers.PRICE_DOCUMENT))
    return bad.agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("bad")).alias("characters"))


@query("filing_files", "S4", f"SELECT {_FILING} FROM fx_filings")
def filing_files(spark, sf):
    """Submissions of every company, all its filings in parallel arrays, written as files of both kinds and read back."""
    names = {"accessionNumber": "accession", "form": "form", "filingDate": "filed", "reportDate": "report_date", "primaryDocument": "document", "items": "items"}
    row = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in names.items()))
    rows = fx.filings(spark, sf).groupBy("symbol", "cik").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    arrays = F.struct(*(F.col(f"rows.{n}").alias(n) for n in names))
    document = F.struct("cik", F.array("symbol").alias("tickers"), F.struct(arrays.alias("recent")).alias("filings"))
    rows = rows.select("symbol", F.to_json(document).alias("document")).withColumn("document", F.replace("document", F.lit("2.02,9.01"), F.lit("2.02;9.01")))
    read = readers.read_filings(spark, _files(rows, "filings", "crc32(symbol) % 10 = 0", input_tasks(spark, sf)))
    return read.withColumn("items", F.replace("items", F.lit(";"), F.lit(",")))


# scalars -----------------------------------------------------------------------------------------------------------

@query("clean_numbers", "P1", "SELECT event_id, price, change_percent AS pct, CASE WHEN kind = 'view' THEN NULL ELSE CAST(volume AS DOUBLE) END AS volume FROM fx_quotes")
def clean_numbers(spark, sf):
    volume = F.when(F.col("kind") == "view", F.element_at(F.array(*[F.lit(w) for w in ("N/A", "na", "None", " UNCH ", "", "inf", "1d")]), (F.col("event_id") % 7 + 1).cast("int"))).otherwise(F.col("volume"))
    return fx.quotes(spark, sf).select(
        "event_id", S.clean_number(F.col("last")).alias("price"), S.clean_number(F.col("change_pct")).alias("pct"), S.clean_number(volume).alias("volume"))


@query("accounting_numbers", "P2", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN -o_totalprice WHEN 1 THEN -o_totalprice WHEN 2 THEN o_totalprice WHEN 3 THEN NULL ELSE o_totalprice END AS amount FROM orders""")
def accounting_numbers(spark, sf):
    number = F.format_number("o_totalprice", 2)
    k = F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("("), number, F.lit(")"))).when(k == 1, F.concat(F.lit("−"), number))
        .when(k == 2, F.concat(F.lit("$"), number)).when(k == 3, F.concat(number, F.lit(" million"))).otherwise(number)
    )
    return fx.table(spark, sf, "orders").select("o_orderkey", S.accounting_number(text).alias("amount"))


@query("strict_dates", "P3", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day,
  strftime(o_orderdate + INTERVAL 3661 SECOND, '%Y-%m-%d %H:%M:%S') AS moment FROM orders""")
def strict_dates(spark, sf):
    text = F.col("o_orderdate").cast("date").cast("string")
    broken = F.when(F.col("o_orderkey") % 6 == 0, F.substring(text, 1, 7)).when(F.col("o_orderkey") % 3 == 0, F.concat(F.substring(text, 1, 8), F.lit("39"))).otherwise(text)
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", S.safe_date(broken).alias("day"),
        S.safe_utc_timestamp(F.concat(text, F.when(F.col("o_orderkey") % 2 == 0, "T01:01:01").otherwise("T03:01:01+02:00"))).alias("moment"))


@query("dates_in_text", "P4", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ',' || CAST(CAST(o_orderdate AS DATE) + 40 AS VARCHAR) AS days FROM orders""")
def dates_in_text(spark, sf):
    d = F.col("o_orderdate").cast("date")
    text = F.concat(
        F.lit("Hsinchu, "), F.date_format(d, "MMMM d, yyyy"), F.lit(" -- not February 31, 1999 nor Smarch 1, 1999, but "),
        F.upper(F.date_format(F.date_add(d, 40), "MMM")), F.lit(". "), F.date_format(F.date_add(d, 40), "d yyyy"), F.lit("."))
    return fx.table(spark, sf, "orders").select("o_orderkey", F.array_join(F.transform(S.text_dates(text), lambda x: x.cast("string")), ",").alias("days"))


@query("years_before", "P5", "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) - to_years(10) AS DATE) AS VARCHAR) AS earlier FROM orders")
def years_before(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", S.years_before(F.col("o_orderdate").cast("date"), 10).alias("earlier"))


@query("base_forms", "P7", "SELECT form, regexp_replace(form, '/A$', '') AS base, count(*) AS n FROM fx_filings GROUP BY ALL")
def base_forms(spark, sf):
    return fx.filings(spark, sf).groupBy("form", S.base_form(F.col("form")).alias("base")).agg(F.count("*").alias("n"))


@query("filing_urls", "P14", """
SELECT accession, 'https://www.sec.gov/Archives/edgar/data/' || CAST(cik AS BIGINT) || '/' || replace(accession, '-', '') || '/' || document AS url FROM fx_filings""")
def filing_urls(spark, sf):
    return filings.with_urls(fx.filings(spark, sf).withColumn("cik", F.lpad("cik", 10, "0"))).select("accession", "url")


@query("content_hashes", "P15", "SELECT count(*) AS rows, count(DISTINCT (symbol, form, filed)) AS contents FROM fx_filings")
def content_hashes(spark, sf):
    rows = fx.filings(spark, sf).select(S.content_hash("symbol", "form", "filed").alias("h"))
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("h").alias("contents"))


@query("valid_symbols", "P16", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 2 AND length('PART.' || p_partkey || '-A') > 10 THEN NULL
  ELSE CASE WHEN p_partkey % 4 = 2 THEN 'PART.' || p_partkey || '-A' ELSE 'P' || p_partkey END END AS symbol FROM part""")
def valid_symbols(spark, sf):
    k, n = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    text = F.when(k == 3, F.concat(n, F.lit("p"))).when(k == 2, F.concat(F.lit("part."), n, F.lit("-a"))).otherwise(F.concat(F.lit("  p"), n, F.lit(" ")))
    return fx.table(spark, sf, "part").select("p_partkey", S.valid_symbol(text).alias("symbol"))


@query("error_summaries", "P17", """
SELECT event_id, nullif(concat_ws('; ', CASE WHEN kind = 'error' THEN 'quote: no price' END, CASE WHEN volume > 50 THEN 'filings: late' END), '') AS errors FROM fx_quotes""")
def error_summaries(spark, sf):
    return fx.quotes(spark, sf).select("event_id", S.error_summary(
        quote=F.when(F.col("kind") == "error", "no price"), facts=F.lit(""), filings=F.when(F.col("volume").cast("int") > 50, "late")).alias("errors"))


@query("short_names", "P18", """
SELECT symbol, left(name || CASE WHEN CAST(cik AS BIGINT) % 3 = 2 THEN ' Holding Partnership Trust' ELSE '' END, 24) AS short FROM fx_catalog""")
def short_names(spark, sf):
    k = F.col("cik").cast("long") % 3
    full = F.concat("name", F.when(k == 0, ", INC.").when(k == 1, " Corporation of Delaware").otherwise(" Holding Partnership Trust"))
    return fx.catalog(spark, sf).select("symbol", S.short_name(full, 24).alias("short"))


@query("nested_state", "P20", """
SELECT event_id, price, kind = 'error' AS failed FROM fx_quotes""")
def nested_state(spark, sf):
    blob = F.to_json(F.struct(S.clean_number(F.col("last")).alias("price"), F.col("kind")))
    state = F.from_json(blob, "price double, kind string")
    return fx.quotes(spark, sf).select("event_id", state["price"].alias("price"), (F.get_json_object(blob, "$.kind") == "error").alias("failed"))


# filings -----------------------------------------------------------------------------------------------------------

@query("relevant_filings", "F4", f"SELECT symbol, accession, form, {day('filed')} FROM v_relevant")
def relevant_filings(spark, sf):
    return filings.relevant_filings(fx.filings(spark, sf)).select("symbol", "accession", "form", "filed")


@query("latest_filing", "T2", f"""
SELECT symbol, accession, form, {day('filed')}, {day('report_date')} FROM v_relevant QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY filed DESC, accession DESC) = 1""")
def latest_filing(spark, sf):
    return filings.latest_filing(filings.relevant_filings(fx.filings(spark, sf)))


@query("recent_filings", "T3", """
SELECT symbol, accession, row_number() OVER (PARTITION BY symbol ORDER BY filed DESC, accession DESC) AS position FROM fx_nation_filings
QUALIFY position <= 20""")
def recent_filings(spark, sf):
    return filings.recent_filings(fx.nation_filings(spark, sf)).select("symbol", "accession", F.col("_rank").cast("long").alias("position"))


@query("new_filings", "S10 Y3 J8", "SELECT accession FROM fx_filings WHERE filed >= DATE '1999-01-01'")
def new_filings(spark, sf):
    rows = fx.filings(spark, sf).select("symbol", "accession", "form", "filed")
    stored = rows.where("filed < date'1999-01-01'")
    twice = rows.unionByName(rows.withColumn("form", F.lit("dup")))
    return sinks.insert_absent(stored, twice, ["symbol", "accession"], ["filed", "form"]).select("accession")


@query("changed_symbols", "Y5", """
WITH o AS (SELECT symbol, arg_max(accession, struct_pack(f := filed, a := accession)) AS a FROM v_relevant WHERE filed < DATE '1999-06-01' GROUP BY symbol),
n AS (SELECT symbol, arg_max(accession, struct_pack(f := filed, a := accession)) AS b FROM v_relevant GROUP BY symbol)
SELECT symbol, b AS accession FROM n LEFT JOIN o USING (symbol) WHERE a IS NULL OR a <> b""")
def changed_symbols(spark, sf):
    rows = filings.relevant_filings(fx.filings(spark, sf))
    return filings.changed_symbols(filings.latest_filing(rows.where("filed < date'1999-06-01'")), filings.latest_filing(rows))


# quotes ------------------------------------------------------------------------------------------------------------

def _clean(spark, sf):
    return quotes.clean_quotes(fx.quotes(spark, sf))


@query("accepted_quotes", "F8 F13", """
SELECT event_id, symbol, price FROM fx_quotes WHERE price > 0 AND symbol IN (SELECT 'U' || c_custkey FROM customer WHERE c_custkey % 3 <> 0)""")
def accepted_quotes(spark, sf):
    known = fx.table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("symbol"))
    return quotes.accepted_quotes(_clean(spark, sf), known).select("event_id", "symbol", "price")


def _customers(spark, sf):
    return fx.table(spark, sf, "customer").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("symbol"))


@query("missing_quotes", "J7 U2", "SELECT 'U' || c_custkey AS symbol FROM customer WHERE 'U' || c_custkey NOT IN (SELECT symbol FROM fx_quotes)")
def missing_quotes(spark, sf):
    return quotes.missing_symbols(_customers(spark, sf), _clean(spark, sf))


@query("requested_symbols", "F13", "SELECT symbol, count(*) AS n FROM fx_quotes WHERE symbol IN ('U1', 'U2', 'U3') GROUP BY symbol")
def requested_symbols(spark, sf):
    return _clean(spark, sf).where(F.col("symbol").isin("U1", "U2", "U3")).groupBy("symbol").agg(F.count("*").alias("n"))


@query("last_good_quotes", "Y2 J11", """
WITH b AS (SELECT * FROM fx_quotes WHERE captured_at >= TIMESTAMP '2024-01-20'),
p AS (SELECT symbol, arg_max(price, event_id) FILTER (price > 0) AS price0, max(captured_at) FILTER (price > 0) AS at0 FROM fx_quotes WHERE captured_at < TIMESTAMP '2024-01-20' GROUP BY symbol),
g AS (SELECT symbol, arg_max(price, event_id) FILTER (price > 0) AS price1, max(captured_at) FILTER (price > 0) AS at1, arg_max(kind, event_id) AS last_kind FROM b GROUP BY symbol)
SELECT symbol, coalesce(price1, price0) AS price, strftime(coalesce(at1, at0), '%Y-%m-%d %H:%M:%S') AS quote_at,
  CASE WHEN last_kind IS NULL THEN 'no_quote_kept_previous'
    WHEN last_kind = 'error' THEN 'invalid_price_kept_previous' END AS error
FROM p LEFT JOIN g USING (symbol)""")
def last_good_quotes(spark, sf):
    rows = _clean(spark, sf)
    before, batch = rows.where("captured_at < timestamp'2024-01-20 00:00:00'"), rows.where("captured_at >= timestamp'2024-01-20 00:00:00'")
    start = before.select("symbol").distinct().select("symbol", F.lit(None).cast("double").alias("price"), F.lit(None).cast("timestamp").alias("quote_at"))
    return quotes.last_good_quotes(quotes.last_good_quotes(start, before), batch)


@query("quote_history", "T4", """
SELECT symbol, event_id, row_number() OVER (PARTITION BY symbol ORDER BY captured_at DESC, event_id DESC) AS position FROM fx_quotes WHERE price > 0 QUALIFY position <= 40""")
def quote_history(spark, sf):
    return quotes.quote_history(_clean(spark, sf).where("valid"), 40).select("symbol", "event_id", F.col("_rank").cast("long").alias("position"))


@query("merge_keep_last_good", "J11", """
WITH o AS (SELECT symbol, max(price) AS price, min(price) AS pe FROM fx_quotes WHERE event_id % 2 = 0 GROUP BY symbol),
n AS (SELECT symbol, max(price) AS price, max(volume) % 3 AS r, sum(event_id) % 4 AS s FROM fx_quotes WHERE event_id % 3 = 0 GROUP BY symbol)
SELECT symbol, CASE WHEN n.r = 0 THEN o.price ELSE coalesce(n.price, o.price) END AS price,
  CASE WHEN n.symbol IS NULL OR s = 0 THEN o.pe WHEN s = 1 THEN NULL ELSE 7e0 END AS pe FROM o FULL JOIN n USING (symbol)""")
def merge_keep_last_good(spark, sf):
    rows = _clean(spark, sf)
    old = rows.where("event_id % 2 = 0").groupBy("symbol").agg(F.max("price").alias("price"), F.min("price").alias("pe"))
    new = rows.where("event_id % 3 = 0").groupBy("symbol").agg(
        F.max("price").alias("price"), (F.max("volume") % 3).alias("r"), (F.sum("event_id") % 4).alias("s"))
    incoming = new.select(
        "symbol", F.when(F.col("r") != 0, F.col("price")).alias("price"), F.when(F.col("s") > 1, 7.0).alias("pe"), (F.col("s") != 0).alias("pe_present"))
    return quotes.merge_keep_last_good(old, incoming, ["price"], ["pe"])


@query("cache_freshness", "A13", """
SELECT strftime(max(captured_at), '%Y-%m-%d %H:%M:%S') AS latest, epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(captured_at))) > 3600 AS stale FROM fx_quotes WHERE price > 0""")
def cache_freshness(spark, sf):
    state = _clean(spark, sf).where("valid").groupBy("symbol").agg(F.max("captured_at").alias("updated_at"))
    return quotes.cache_freshness(state, F.lit("2024-01-31 00:00:00").cast("timestamp"), 3600)


@query("facts_due", "F12 Y6", """
WITH s AS (SELECT symbol, max(captured_at) AS t, max(event_id) % 4 AS v FROM fx_quotes GROUP BY symbol)
SELECT symbol FROM s WHERE NOT (v <> 0 AND v <> 1 AND epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(t)) < 24 * 3600)""")
def facts_due(spark, sf):
    state = _clean(spark, sf).groupBy("symbol").agg(F.max("captured_at").alias("facts_updated_at"), (F.max("event_id") % 4).alias("v"))
    state = state.withColumns({"schema_version": F.when(F.col("v") == 0, 2).otherwise(3), "quality_version": F.when(F.col("v") != 1, 1)})
    return quotes.facts_due(state, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("symbol")


@query("valuations_due", "Y6 Y8 F12", """
WITH s AS (SELECT symbol, max(captured_at) AS t, max(event_id) % 6 AS v FROM fx_quotes GROUP BY symbol)
SELECT symbol, v IN (1, 2, 3) AS retrying FROM s WHERE v = 0
  OR epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(t)) >= CASE WHEN v IN (1, 2, 3) THEN 300 ELSE 6 * 3600 END""")
def valuations_due(spark, sf):
    v = F.col("v")
    state = _clean(spark, sf).groupBy("symbol").agg(F.max("captured_at").alias("valuation_updated_at"), (F.max("event_id") % 6).alias("v"))
    state = state.withColumns({
        "algorithm_version": F.when(v == 0, 3).otherwise(4), "pending": v == 1, "valuation_error": F.when(v == 2, "offline"),
        "status": F.when(v == 3, "stale").otherwise("qualified")})
    return quotes.valuations_due(state, F.lit("2024-01-31 00:00:00").cast("timestamp")).select("symbol", "retrying")


@query("run_outcomes", "A14 Y9", """
SELECT CAST(CAST(captured_at AS DATE) AS VARCHAR) AS day, count(*) FILTER (price > 0) AS updated, count(*) FILTER (price IS NULL) AS failed,
  CASE WHEN count(*) FILTER (price IS NULL) > 0 THEN 'partial' ELSE 'ok' END AS status FROM fx_quotes GROUP BY 1""")
def run_outcomes(spark, sf):
    rows = _clean(spark, sf).withColumn("day", F.col("captured_at").cast("date"))
    return quotes.run_outcome(rows, ["day"])


@query("run_log", "S11 Y9", """
SELECT 'quotes' AS source, CASE WHEN count(*) FILTER (price IS NULL) > 0 THEN 'partial' ELSE 'ok' END AS status,
  left(repeat('updated ' || count(*) FILTER (price > 0) || '; failed ' || count(*) FILTER (price IS NULL) || ' ', 60), 1000) AS detail,
  CAST(CAST(captured_at AS DATE) AS VARCHAR) AS created_at FROM fx_quotes GROUP BY CAST(captured_at AS DATE)""")
def run_log(spark, sf):
    rows = quotes.run_outcome(_clean(spark, sf).withColumn("day", F.col("captured_at").cast("date")), ["day"])
    detail = F.repeat(F.concat(sinks.detail_text(F.col("updated"), F.col("failed")), F.lit(" ")), F.lit(60))
    path = shared_folder(spark, "outcomes")
    sinks.write_run_log(rows.select(F.lit("quotes").alias("source"), "status", detail.alias("detail"), F.col("day").alias("created_at")), path, 1000)
    return spark.read.parquet(path)


@query("quote_upsert", "S9 Y7", """
SELECT symbol, arg_max(price, event_id) AS price, max(event_id) AS event_id FROM fx_quotes WHERE price > 0 GROUP BY symbol""")
def quote_upsert(spark, sf):
    rows = _clean(spark, sf).where("valid").select("symbol", "price", "event_id")
    stored = matching.keep_latest(rows.where("event_id % 2 = 0"), ["symbol"], "event_id")
    return sinks.upsert(stored, rows.where("event_id % 2 = 1"), ["symbol"], ["event_id"])


@query("sample_upsert", "Y7 S9", """
SELECT symbol, CAST(date AS VARCHAR) AS date, 'daily' AS frequency, CASE WHEN date >= DATE '2001-01-01' THEN pe ELSE pe * 2 END AS pe FROM v_states WHERE pe IS NOT NULL""")
def sample_upsert(spark, sf):
    samples = V.states(spark, sf).where("pe IS NOT NULL").select("symbol", "date", F.lit("daily").alias("frequency"), "pe")
    stored = samples.withColumn("pe", F.col("pe") * 2).withColumn("run", F.lit(1))
    fresh = samples.where("date >= date'2001-01-01'").withColumn("run", F.lit(2))
    return sinks.upsert(stored, fresh, ["symbol", "date", "frequency"], ["run"]).drop("run")


@query("results_export", "S12", """
SELECT s.symbol, w.years, s.status, w.valid_samples, w.max_missing_run FROM v_summary s LEFT JOIN v_windows w USING (symbol)""")
def results_export(spark, sf):
    """Written as JSON files, read back with a schema, one row per symbol and horizon."""
    path = shared_folder(spark, "export")
    sinks.export_results(sinks.nested_results(V.summary(spark, sf), V.windows(spark, sf)), path)
    payload = "valuation struct<status:string>, coverage array<struct<years:int,valid_samples:bigint,max_missing_run:bigint>>"
    read = spark.read.schema("symbol string, payload string").json(path).select("symbol", F.from_json("payload", payload).alias("p"))
    return read.select("symbol", "p.valuation.status", F.explode_outer("p.coverage").alias("c")).select("symbol", "c.years", "status", "c.valid_samples", "c.max_missing_run")


# directory ---------------------------------------------------------------------------------------------------------

_SEARCH = """
SELECT symbol, name, CASE WHEN lower(symbol) = '{n}' THEN 0 WHEN lower(name) = '{n}' THEN 1 WHEN starts_with(lower(symbol), '{n}') THEN 2
  WHEN starts_with(lower(name), '{n}') THEN 3 WHEN contains(lower(symbol), '{n}') OR contains(lower(name), '{n}') THEN 4 END AS rank FROM fx_catalog"""


@query("catalog_search", "T1", f"SELECT * FROM ({_SEARCH.format(n='red')}) WHERE rank IS NOT NULL ORDER BY rank, length(name), symbol LIMIT 8")
def catalog_search(spark, sf):
    return directory.search_catalog(fx.catalog(spark, sf), " Red ").select("symbol", "name", "rank")


@query("catalog_search_many", "T1", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{n}' AS needle, symbol, name, rank, row_number() OVER (ORDER BY rank, length(name), symbol) AS position FROM ({_SEARCH.format(n=n)}) WHERE rank IS NOT NULL) WHERE position <= 8"
    for n in ("p12", "blue", "amzn", "hot gear")))
def catalog_search_many(spark, sf):
    found = directory.search_many(fx.catalog(spark, sf), ["P12", "blue", "AWS", "hot gear"])
    return found.withColumn("position", F.col("position").cast("long"))


_BRAND = "contains(lower(symbol), 'brand#2') OR contains(lower(name), 'brand#2') OR contains(lower(alias), 'brand#2')"


@query("alias_matches", "F11", f"SELECT symbol, name FROM fx_catalog WHERE {_BRAND}")
def alias_matches(spark, sf):
    return directory.local_matches(fx.catalog(spark, sf), "Brand#2").select("symbol", "name")


@query("merged_search", "U5", """
WITH l AS (SELECT symbol, name FROM fx_catalog WHERE contains(lower(symbol), 'p199')), r AS (SELECT symbol, name FROM fx_catalog WHERE contains(lower(symbol), 'p19'))
SELECT origin, symbol, name FROM (SELECT 0 AS origin, * FROM l UNION ALL SELECT 1, * FROM r WHERE symbol NOT IN (SELECT symbol FROM l)) ORDER BY origin, symbol LIMIT 8""")
def merged_search(spark, sf):
    catalog = fx.catalog(spark, sf)
    remote = catalog.where(F.contains(F.lower("symbol"), F.lit("p19"))).select("symbol", "name")
    return directory.merged_results(directory.local_matches(catalog, "p199").select("symbol", "name"), remote)


@query("register_symbols", "J10 P16", """
SELECT 'P' || p_partkey * 2 AS symbol, CASE WHEN p_partkey % 3 = 0 THEN 'Named' ELSE coalesce(name, 'P' || p_partkey * 2) END AS name, cik,
  coalesce(CASE WHEN name IS NOT NULL THEN 'US' END, 'US') AS exchange FROM part LEFT JOIN fx_catalog ON symbol = 'P' || p_partkey * 2""")
def register_symbols(spark, sf):
    key = F.col("p_partkey")
    requests = fx.table(spark, sf, "part").select(
        F.concat(F.lit(" p"), (key * 2).cast("string")).alias("symbol"), F.when(key % 3 == 0, "Named").alias("name"),
        F.lit(None).cast("string").alias("cik"), F.lit(None).cast("string").alias("exchange"))
    return directory.register(requests, fx.catalog(spark, sf))


@query("watch_order", "T6", """
SELECT symbol, strftime(tracked_at, '%Y-%m-%d %H:%M:%S') AS tracked_at FROM (SELECT symbol, min(captured_at) AS tracked_at FROM fx_quotes GROUP BY symbol) ORDER BY 2, 1""")
def watch_order(spark, sf):
    return quotes.tracked_order(_clean(spark, sf).groupBy("symbol").agg(F.min("captured_at").alias("tracked_at")))


# streams -----------------------------------------------------------------------------------------------------------

def _arrivals(rows, key):
    """Three deliveries that are not in order of time: each has rows of all days, and the later ones repeat some of the earlier."""
    part = F.pmod(F.col(key), F.lit(3))
    again = F.pmod(F.col(key), F.lit(7)) == 0
    return [rows.where(part == 0), rows.where((part == 1) | (again & (part == 0))), rows.where((part == 2) | again)]


def _run(spark, rows, key, name, start):
    """Write each delivery to an inbox and let the stream take what has arrived."""
    inbox, checkpoint = shared_folder(spark, f"{name}-inbox"), shared_folder(spark, f"{name}-checkpoint")
    for delivery in _arrivals(rows, key):
        delivery.write.mode("append").parquet(inbox)
        start(spark.readStream.schema(delivery.schema).parquet(inbox), checkpoint).awaitTermination()


@query("quote_stream", "Y1", """
SELECT symbol, strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at, price FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, captured_at ORDER BY event_id % 3, event_id) AS r FROM fx_quotes WHERE price > 0) WHERE r = 1""")
def quote_stream(spark, sf):
    path = shared_folder(spark, "quote_history")
    rows = quotes.clean_quotes(fx.quote_rows(fx.table(spark, sf, "events")))
    _run(spark, rows, "event_id", "quotes", lambda stream, checkpoint: streams.append_quotes(stream, path, checkpoint, buckets=4))
    return Table(spark, path).read().select("symbol", "captured_at", "price")


@query("latest_quote_stream", "Y2 S9", """
SELECT symbol, arg_max(price, struct_pack(captured_at, event_id)) FILTER (price > 0) AS price,
  strftime(max(captured_at) FILTER (price > 0), '%Y-%m-%d %H:%M:%S') AS quote_at,
  CASE WHEN arg_max(CASE WHEN price > 0 THEN 1 ELSE 0 END, struct_pack(captured_at, event_id)) = 0 THEN 'invalid_price_kept_previous' END AS error FROM fx_quotes GROUP BY symbol""")
def latest_quote_stream(spark, sf):
    path = shared_folder(spark, "latest_quote")
    rows = quotes.clean_quotes(fx.quote_rows(fx.table(spark, sf, "events")))
    _run(spark, rows, "event_id", "latest", lambda stream, checkpoint: streams.upsert_quotes(stream, path, checkpoint))
    return Table(spark, path).read().select("symbol", "price", "quote_at", "error")


@query("filing_stream", "Y3 S10", """
SELECT symbol, accession, o_orderkey % 3 AS first_batch FROM (SELECT *, CAST(left(accession, 10) AS BIGINT) AS o_orderkey FROM v_relevant)""")
def filing_stream(spark, sf):
    path = shared_folder(spark, "filing_events")
    rows = filings.relevant_filings(fx.filing_rows(fx.table(spark, sf, "orders"))).select("symbol", "accession", "filed")
    rows = rows.withColumn("number", F.substring("accession", 1, 10).cast("long"))
    _run(spark, rows, "number", "filings", lambda stream, checkpoint: streams.append_filings(stream, path, checkpoint, lambda n: F.lit(n).cast("long"), 4))
    return Table(spark, path).read().select("symbol", "accession", F.col("discovered_at").alias("first_batch"))


@query("batch_log", "Y9 S11", """
SELECT 'quotes' AS source, 'ok' AS status, 'batch ' || b || '; rows ' || n AS detail, b AS created_at FROM (
  SELECT 0 AS b, count(*) FILTER (event_id % 3 = 0) AS n FROM fx_quotes UNION ALL
  SELECT 1, count(*) FILTER (event_id % 3 = 1 OR (event_id % 7 = 0 AND event_id % 3 = 0)) FROM fx_quotes UNION ALL
  SELECT 2, count(*) FILTER (event_id % 3 = 2 OR event_id % 7 = 0) FROM fx_quotes)""")
def batch_log(spark, sf):
    log = shared_folder(spark, "run_log")
    step = streams.logged(lambda batch, number: None, "quotes", log, lambda number: F.lit(number))
    rows = fx.table(spark, sf, "events").select("event_id")
    _run(spark, rows, "event_id", "log", lambda stream, checkpoint: streams.each_batch(stream, checkpoint, step))
    return spark.read.parquet(log)


_NEEDLES = "(SELECT DISTINCT lower(right(symbol, 3)) AS needle FROM fx_catalog UNION SELECT DISTINCT substr(lower(name), 3, 6) FROM fx_catalog)"


@query("catalog_search_indexed", "T1 F11", f"""
SELECT needle, symbol, name, rank, position FROM (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY rank, length(name), symbol) AS position FROM (
  SELECT needle, symbol, name, CASE WHEN lower(symbol) = needle THEN 0 WHEN lower(name) = needle THEN 1 WHEN starts_with(lower(symbol), needle) THEN 2
    WHEN starts_with(lower(name), needle) THEN 3 ELSE 4 END AS rank
  FROM fx_catalog, (SELECT DISTINCT CASE needle WHEN 'aws' THEN 'amzn' ELSE needle END AS needle FROM (SELECT trim(needle) AS needle FROM {_NEEDLES}) WHERE needle <> '')
  WHERE contains(lower(symbol), needle) OR contains(lower(name), needle))) WHERE position <= 8""")
def catalog_search_indexed(spark, sf):
    """Searches for the end of every symbol and a piece of every name, through stored postings."""
    catalog = fx.catalog(spark, sf)
    ends = catalog.select(F.lower(F.right("symbol", F.lit(3))).alias("text"))
    texts = ends.unionByName(catalog.select(F.substring(F.lower("name"), 3, 6).alias("text")))
    path = shared_folder(spark, "grams")
    catalog_index.write_index(catalog, path, input_tasks(spark, sf, 4 << 20))
    return catalog_index.search_indexed(catalog, path, texts).withColumn("position", F.col("position").cast("long"))


@query("archive_of_symbols", "S5 F13", f"""
SELECT {_FILING} FROM fx_filings WHERE filed >= DATE '1997-01-01' AND symbol IN (SELECT 'C' || c_custkey FROM customer WHERE c_acctbal < 0)""")
def archive_of_symbols(spark, sf):
    """Filings of the symbols with a negative balance, from the archive files that hold them."""
    rows = _filing_payloads(spark, sf)
    recent_path, archive, index = (shared_folder(spark, purpose) for purpose in ("recent", "archive", "file-index"))
    rows.where("filed >= date'2000-01-01'").drop("filed").write.json(recent_path)
    old = rows.where("filed < date'2000-01-01'").withColumn("filing_to", F.concat(F.year("filed").cast("string"), F.lit("-12-31")))
    old.drop("filed").repartitionByRange(16, "symbol").write.partitionBy("filing_to").json(archive)
    file_index.update_index(spark, archive, index, readers.filing_payloads(spark, recent_path))
    wanted = fx.table(spark, sf, "customer").where("c_acctbal < 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"))
    return file_index.read_archive_of(spark, recent_path, archive, index, wanted, "1997-01-01")


_CLOCKS = ("2024-01-08 00:00:00", "2024-01-16 12:00:00", "2024-02-01 00:00:00", "2024-02-01 03:00:00", "2024-02-01 06:30:00")


@query("deadline_stream", "Y6 Y8", f"""
WITH q AS (SELECT symbol, event_id, captured_at AS seen, captured_at + CASE WHEN kind = 'error' THEN INTERVAL 5 MINUTE ELSE INTERVAL 6 HOUR END AS due FROM fx_quotes),
n AS (SELECT clock, symbol, arg_max(due, struct_pack(seen, event_id)) AS due FROM q, (SELECT unnest([{', '.join(f"TIMESTAMP '{c}'" for c in _CLOCKS)}]) AS clock) WHERE seen < clock GROUP BY ALL)
SELECT symbol, strftime(due, '%Y-%m-%d %H:%M:%S') AS due, strftime(min(clock), '%Y-%m-%d %H:%M:%S') AS fired_at FROM n WHERE due <= clock GROUP BY symbol, due""")
def deadline_stream(spark, sf):
    """Each quote sets its symbol's next check, six hours on, or five minutes after a failed one. Three deliveries, then two
    ticks of the clock without input."""
    path, inbox, checkpoint = (shared_folder(spark, purpose) for purpose in ("deadlines", "deadlines-inbox", "deadlines-checkpoint"))
    wait = F.when(F.col("kind") == "error", 300).otherwise(6 * 3600).cast("bigint")
    at = F.col("captured_at").cast("timestamp")
    rows = fx.quotes(spark, sf).select(
        F.col("symbol").alias("key"), F.timestamp_micros(F.unix_micros(at) + wait * 1_000_000).alias("due"), at.alias("at"), F.col("event_id").alias("seq"))
    before = "1970-01-01 00:00:00"
    for number, clock in enumerate(_CLOCKS):
        if number < 3:
            delivery = rows.where((F.col("at") >= F.lit(before).cast("timestamp")) & (F.col("at") < F.lit(clock).cast("timestamp")))
            delivery.write.mode("append").parquet(inbox)
            deadlines.deadline_stream(spark.readStream.schema(rows.schema).parquet(inbox), path, checkpoint, buckets=4).awaitTermination()
        deadlines.fire(spark, path, datetime.fromisoformat(clock), buckets=4)
        before = clock
    return Table(spark, f"{path}/emitted").read().select(F.col("key").alias("symbol"), "due", "fired_at")
