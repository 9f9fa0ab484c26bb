"""Audits and the text corpus: pages, reports, releases, content checks and publication scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import audit, corpus, matching, reconcile, valuation
from plumbline.plans import fixtures as fx
from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.plans.sql_views import day, r2
from plumbline.session import input_tasks, shared_folder

# pages -------------------------------------------------------------------------------------------------------------


def _pages(spark, sf):
    return fx.table(spark, sf, "pages")


def _dressed(spark, sf):
    """Pages with the head elements, links and images the raw ones lack, written in every way a page may quote them."""
    k = F.col("page_id")
    n = k.cast("string")
    head = F.concat(
        F.when(k % 3 == 0, F.concat(F.lit("<meta property='og:title' content=\"Story's  "), n, F.lit(' &amp; more">'))).otherwise(""),
        F.when(k % 4 == 0, F.concat(F.lit("<meta content='Writer &quot;Q&quot; "), n, F.lit("' name=author>"))).otherwise(""),
        F.when(k % 8 == 1, F.concat(F.lit('<h4 data-x="a>b" id=js_name> Desk <i>'), n, F.lit("</i> <b>East</b> </h4>"))).otherwise(""),
        F.when(k % 8 == 5, F.concat(F.lit("<!-- <p id=js_name>No</p> --><div id='js_name'><div>Desk</div><div><div>"), n, F.lit("</div><b></div> East</div></b> West <div>x</div>"))).otherwise(""),
        F.when(k % 5 == 0, F.lit("<script>var ct = \"850000000\";</script>")).otherwise(""),
        F.when(k % 5 == 1, F.lit("<meta name='publication_date' content='2001-02-03'>")).otherwise(""),
        F.when(k % 5 == 2, F.lit("<script>var publish_time = '3 o\\'clock';</script>")).otherwise(""),
        F.when(k % 2 == 0, F.lit('<meta property="og:description" content="It&#8217;s &#x41; caf&eacute; &bogus;">')).otherwise(""),
        F.concat(F.lit('<a data-href="/no" title="x" href="/q?it\'s='), n, F.lit('#top">one</a><a href=/plain/'), n, F.lit(">two</a><a href='#only'>three</a>")),
        F.concat(F.lit('<img alt="pic" data-w="640" src="data:image/svg+xml,x" data-src="https://img.example.org/'), n, F.lit('.png?a=1#frag">')),
        F.when(k % 2 == 1, F.concat(F.lit("<IMG width=20 alt='a > b' SRC='/local/"), n, F.lit(".gif'/>"))).otherwise('<img src="data:image/svg+xml,y">'),
    )
    return _pages(spark, sf).withColumn("html", F.concat(head, F.col("html")))


_TITLE = "nullif(trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')), '')"


@query("page_metadata", "X1", f"""
SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'Story''s ' || page_id || ' & more' ELSE {_TITLE} END AS title,
  CASE page_id % 4 WHEN 0 THEN 'Writer "Q" ' || page_id WHEN 1 THEN 'Desk ' || page_id || ' East' END AS author,
  CASE page_id % 5 WHEN 0 THEN '1996-12-07 23:06:40' WHEN 1 THEN '2001-02-03' WHEN 2 THEN '3 o''clock' END AS published_at,
  CASE WHEN page_id % 2 = 0 THEN 'It’s A café &bogus;' END AS description FROM pages""")
def page_metadata(spark, sf):
    return corpus.page_metadata(_dressed(spark, sf))


@query("page_text", "X2", "SELECT page_id, text, length(text) AS characters FROM v_page_text")
def page_text(spark, sf):
    return corpus.page_text(_pages(spark, sf)).withColumn("characters", F.col("characters").cast("long"))


@query("page_references", "X2", """
SELECT page_id, 'It’s A é &bogus; €' || page_id || chr(10) || 'two' || chr(10) || 'lines x' AS text FROM pages""")
def page_references(spark, sf):
    html = F.concat(
        F.lit("<script>if (a < b) {}</script><p title='a>b'>It&#8217;s &#x41; &eacute; &bogus; &#128;"), F.col("page_id").cast("string"),
        F.lit("</p><div class=\"it's\">two<br/>lines&nbsp; x</div><template>a<template>b</template>c</template>"))
    return corpus.page_text(_pages(spark, sf).withColumn("html", html)).select("page_id", "text")


@query("page_links", "X3", """
SELECT page_id, 0 AS position, '/q?it''s=' || page_id AS link FROM pages UNION ALL SELECT page_id, 1, '/plain/' || page_id FROM pages
UNION ALL SELECT page_id, position + 3, link FROM (SELECT page_id, unnest(range(len(l))) AS position, regexp_replace(trim(unnest(l)), '#.*$', '') AS link
  FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS l FROM pages)) WHERE link <> ''""")
def page_links(spark, sf):
    return corpus.page_links(_dressed(spark, sf)).withColumn("position", F.col("position").cast("long"))


@query("page_images", "X3", """
SELECT page_id, 1 AS position, 'https://img.example.org/' || page_id || '.png?a=1' AS source_url, 'pic' AS alt, '640' AS width, 'listed' AS status FROM pages
UNION ALL SELECT page_id, 2, CASE WHEN page_id % 2 = 1 THEN '/local/' || page_id || '.gif' END, CASE WHEN page_id % 2 = 1 THEN 'a > b' ELSE '' END, CASE WHEN page_id % 2 = 1 THEN '20' ELSE '' END,
  CASE WHEN page_id % 2 = 1 THEN 'listed' ELSE 'missing_source' END FROM pages""")
def page_images(spark, sf):
    return corpus.page_images(_dressed(spark, sf))


@query("allowed_hosts", "F6", """
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) IN ('m.ththth.example.net', 'thther.example.org') AS allowed FROM pages""")
def allowed_hosts(spark, sf):
    return _pages(spark, sf).select("page_id", S.allowed_host(F.col("url"), ("m.ththth.example.net", "thther.example.org")).alias("allowed"))


@query("corpus_manifest", "X7 J11", f"""
SELECT p.page_id, CASE WHEN p.page_id % 4 <> 0 THEN CAST(octet_length(encode(html)) AS BIGINT) ELSE 1 END AS bytes,
  CASE WHEN p.page_id % 4 <> 0 THEN length(text) ELSE 2 END AS text_characters, 0 AS images,
  CASE WHEN p.page_id % 4 <> 0 THEN len(regexp_extract_all(html, '(?i)<a\\b')) ELSE 0 END AS links,
  CASE WHEN p.page_id % 4 <> 0 THEN sha256(html) ELSE 'old' END AS sha256, CASE WHEN p.page_id % 4 <> 0 AND {_TITLE} IS NULL THEN 'failed' ELSE 'archived' END AS status
FROM pages p JOIN v_page_text USING (page_id)""")
def corpus_manifest(spark, sf):
    pages = _pages(spark, sf)
    one, two, none = (F.lit(v).cast("long") for v in (1, 2, 0))
    earlier = pages.where("page_id % 2 = 0").select(
        "page_id", one.alias("bytes"), two.alias("text_characters"), none.alias("images"), none.alias("links"), F.lit("old").alias("sha256"),
        F.lit("archived").alias("status"))
    return corpus.corpus_manifest(pages.where("page_id % 4 <> 0"), earlier)


@query("corpus_totals", "A15", """
SELECT count(*) AS items, 0 AS images, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes, count(*) FILTER (page_id % 10 = 3) AS issues FROM pages""")
def corpus_totals(spark, sf):
    pages = _pages(spark, sf)
    return audit.corpus_totals(corpus.corpus_manifest(pages), pages.where("page_id % 10 = 3"))


def _archive(spark, sf):
    """A manifest and the stored content: one in ten altered, dropped or added."""
    k = F.col("page_id")
    pages = _pages(spark, sf).withColumn("item", F.concat(F.lit("page-"), k.cast("string"), F.when(k % 7 == 0, ".png").otherwise(".html")))
    manifest = pages.where(k % 10 != 4).select("item", F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("sha256"))
    changed = F.when(k % 10 == 1, F.concat(F.col("html"), F.lit("!"))).when(k % 10 == 2, F.concat(F.lit("?"), F.substr(F.col("html"), F.lit(2)))).otherwise(F.col("html"))
    stored = F.when(k % 10 == 5, F.concat(F.encode(changed, "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode(changed, "UTF-8"))
    content = pages.where(k % 10 != 3).select("item", stored.alias("content"))
    return manifest, content


@query("verify_content", "Q4", """
WITH p AS (SELECT page_id, page_id % 10 AS k, 'page-' || page_id || CASE WHEN page_id % 7 = 0 THEN '.png' ELSE '.html' END AS item, html FROM pages)
SELECT item, 'unlisted' AS issue FROM p WHERE k = 4 UNION ALL SELECT item, 'missing' FROM p WHERE k = 3
UNION ALL SELECT item, 'byte_count' FROM p WHERE k IN (1, 5) UNION ALL SELECT item, 'sha256' FROM p WHERE k IN (1, 2, 5)
UNION ALL SELECT item, 'bad_encoding' FROM p WHERE k = 5 AND page_id % 7 <> 0
UNION ALL SELECT item, unnest(['bad_signature', 'html_as_image']) FROM p WHERE page_id % 7 = 0 AND k NOT IN (3, 4)""")
def verify_content(spark, sf):
    return audit.verify_content(*_archive(spark, sf))


@query("unlisted_items", "U7", "SELECT 'page-' || page_id || CASE WHEN page_id % 7 = 0 THEN '.png' ELSE '.html' END AS item FROM pages WHERE page_id % 10 = 4")
def unlisted_items(spark, sf):
    manifest, content = _archive(spark, sf)
    return content.select("item").join(manifest.select("item"), "item", "left_anti")


@query("sensitive_documents", "Q5", """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 50 = 0 THEN '/.env' WHEN doc_id % 50 = 1 THEN '/.env.example' WHEN doc_id % 50 = 2 THEN '/cert.PEM' ELSE '.txt' END AS path, * FROM documents)
SELECT path, 'forbidden_path' AS issue FROM d WHERE doc_id % 50 IN (0, 2) UNION ALL SELECT path, 'size' FROM d WHERE n_chars > 20000
UNION ALL SELECT path, 'credential' FROM d WHERE regexp_matches(text, 'token = "[0-9a-f]{40}"')
UNION ALL SELECT path, 'brand_in_text' FROM d WHERE regexp_matches(text, '(?i)(^|[^A-Za-z])the([^A-Za-z]|$)')""")
def sensitive_documents(spark, sf):
    k = F.col("doc_id") % 50
    suffix = F.when(k == 0, "/.env").when(k == 1, "/.env.example").when(k == 2, "/cert.PEM").otherwise(".txt")
    documents = fx.table(spark, sf, "documents").withColumn("path", F.concat(F.col("doc_id").cast("string"), suffix))
    return audit.scan_sensitive(
        documents, "path", "text", "n_chars", (*audit.SECRET_PATTERNS, r'token = "[0-9a-f]{40}"'), ("the",), size_limit=20000)


# releases and reports ----------------------------------------------------------------------------------------------

_RELEASE = """(SELECT symbol, qs, qe, n, q, CAST(year(qe) AS INTEGER) AS y, CAST(abs(income) % 9000 + 100 AS BIGINT) AS a, CAST(cents % 900000 + 1000 AS BIGINT) AS b,
  CASE WHEN (cents + n) % 10 = 0 THEN 'no_usd_eps' WHEN (cents + n) % 10 = 1 THEN 'dates_not_reconciled' END AS reason FROM fx_quarters)"""


def _releases(spark, sf):
    a = (F.abs("income") % 9000 + 100) / F.lit(100.0)
    b = (F.col("cents") % 900000 + 1000) / F.lit(100.0)
    k = (F.col("cents") + F.col("n")) % 10
    told = F.when(k == 1, F.date_add("qe", -40)).otherwise(F.date_add("qe", 16))
    # one in three numbers is broken by layout spaces, which the reader repairs; some texts have long front matter
    revenue = F.format_number(b, 2)
    broken = F.when(k % 3 == 2, F.regexp_replace(revenue, r"\.", ". ")).otherwise(revenue)
    front = F.when(k % 4 == 3, F.repeat(F.lit("Statements about the future may turn out otherwise; see the notes of May 4, 1990. "), F.lit(40))).otherwise("")
    text = F.concat(
        front, F.lit("KEELUNG,  "), F.date_format(told, "MMMM d, yyyy"), F.lit(" (Newsroom) -- Figures for the three months to "), F.date_format("qe", "MMMM d, yyyy"),
        F.lit(".\nConsolidated revenue reached NT$"), broken, F.lit(" billion; in dollar terms revenue was US$"), F.format_number(b / 10, 3),
        F.lit(" billion. Net profit came to NT $"), F.format_number(a * 2, 2), F.lit(" billion. Diluted EPS was NT$"), F.format_number(a, 2), F.lit(" (US$"),
        F.format_number(a / 5, 3), F.when(k == 0, " per ordinary share).").otherwise(" for each ADR)."))
    return fx.quarters(spark, sf).select("symbol", F.year("qe").alias("year"), F.col("q").alias("quarter"), text.alias("text"))


@query("release_facts", "X5 P4", f"""
SELECT symbol, CAST(qs AS VARCHAR) AS start, CAST(qe AS VARCHAR) AS "end", CASE WHEN reason IS NULL THEN CAST(CAST(qe + 16 AS DATE) AS VARCHAR) END AS filed,
  CASE WHEN reason IS NULL THEN round(a / 5e2, 3) END AS eps, CASE WHEN reason IS NULL THEN a / 1e2 END AS eps_native,
  CASE WHEN reason IS NULL THEN round(b / 1e2 * 1e9, 0) END AS revenue_native, CASE WHEN reason IS NULL THEN round(a / 1e2 * 2 * 1e9, 0) END AS income_native,
  CASE WHEN reason IS NULL THEN round(b / 1e3 * 1e9, 0) END AS revenue_usd, reason FROM {_RELEASE}""")
def release_facts(spark, sf):
    rows = corpus.release_facts(_releases(spark, sf))
    return rows.withColumns({
        "eps": F.round("eps", 3), **{n: F.round(n, 0) for n in ("revenue_native", "income_native", "revenue_usd")}})


@query("release_conflicts", "X6 A6", f"""
SELECT symbol, CAST(qe AS VARCHAR) AS "end", 2 AS values, 2 AS releases FROM {_RELEASE} WHERE reason IS NULL AND n % 4 = 0""")
def release_conflicts(spark, sf):
    rows = corpus.release_facts(_releases(spark, sf)).select("symbol", "end", "eps")
    again = rows.where("month(end) = 3").withColumn("eps", F.col("eps") + 1)
    return corpus.release_conflicts(rows.unionByName(again))


@query("extracted_conflicts", "A6", """
SELECT symbol, "end"::VARCHAR AS "end", count(DISTINCT val) AS n FROM v_obs WHERE metric = 'revenue' GROUP BY ALL HAVING count(DISTINCT val) > 1""")
def extracted_conflicts(spark, sf):
    return V.raw_obs(spark, sf).where("metric = 'revenue'").groupBy("symbol", "end").agg(F.count_distinct("val").alias("n")).where("n > 1")


def _reports(spark, sf):
    k = F.col("cents") % 10
    now = F.concat(F.col("q").cast("string"), F.lit("Q"), F.date_format("qe", "yy"))
    before = F.concat(F.quarter(F.add_months("qe", -3)).cast("string"), F.lit("Q"), F.date_format(F.add_months("qe", -3), "yy"))
    year_ago = F.concat(F.col("q").cast("string"), F.lit("Q"), F.date_format(F.add_months("qe", -12), "yy"))
    heads = F.concat(now, F.lit(" "), F.when(k == 1, F.concat(year_ago, F.lit(" "), before)).otherwise(F.concat(before, F.lit(" "), year_ago)))
    unit = F.when(k == 0, "(In US$ billions) ").otherwise("(In NT$ billions) ")

    def three(column, sign):
        value = F.abs(column) % 100000 + 100
        shown = [F.format_number((value + step) / F.lit(100.0), 2) for step in (0, 7, 14)]
        if sign < 0:
            shown = [F.concat(F.lit("("), s, F.lit(")")) for s in shown]
        return F.concat_ws(" ", *shown)

    again = F.when(k == 2, F.concat(F.lit("\nNet Operating Sources/(Uses) "), three(F.col("cash_flow"), 1))).otherwise("")
    text = F.concat(
        F.lit("Summary\nII - 2. Operating Income Analysis\n"), unit, heads, F.lit("\nOperating   Income "), three(F.col("operating"), 1),
        F.lit("\nIV - 1. Quarterly Cash Flow Analysis\n"), unit, heads, F.lit("\nNet Operating Sources/(Uses) "), three(F.col("cash_flow"), 1), again,
        F.lit("\nCapital Expenditures "), F.when(k == 3, three(F.col("capex"), 1)).otherwise(three(F.col("capex"), -1)),
        F.lit("\nV. Outlook\nCapital Expenditures 31.40 22.20 53.60"))
    cover = F.concat(F.lit("Contents\nII - 2. Operating Income Analysis\nIV - 1. Quarterly Cash Flow Analysis\nNet Operating Sources/(Uses) "), three(F.col("cash_flow"), 1))
    documents = F.array(F.struct(F.lit("report").alias("document"), text.alias("text")), F.struct(F.lit("cover").alias("document"), cover.alias("text")))
    return fx.quarters(spark, sf).select("symbol", F.year("qe").alias("year"), F.col("q").alias("quarter"), F.inline(documents))


_REPORT = " UNION ALL ".join(
    f"SELECT symbol, CAST(year(qe) AS INTEGER) AS year, CAST(q AS INTEGER) AS quarter, '{m}' AS metric, {sign} * CAST(abs({c}) % 100000 + 100 AS BIGINT) AS v, {sign} AS s, {bad} AS bad FROM fx_quarters"
    for m, c, sign, bad in (("operating_income", "operating", 1, "cents % 10 < 2"), ("operating_cash_flow", "cash_flow", 1, "cents % 10 < 3"),
                            ("capex", "capex", -1, "cents % 10 IN (0, 1, 3)")))


@query("report_line_items", "X4 W10", f"""
SELECT symbol, year, quarter, 'cover' AS document, metric, NULL AS current, NULL AS previous, NULL AS year_ago, 'no_unambiguous_line' AS reason FROM ({_REPORT})
UNION ALL SELECT symbol, year, quarter, 'report', metric, CASE WHEN NOT bad THEN round(v / 1e2 * 1e9, 0) END AS current, CASE WHEN NOT bad THEN round((v + s * 7) / 1e2 * 1e9, 0) END AS previous,
  CASE WHEN NOT bad THEN round((v + s * 14) / 1e2 * 1e9, 0) END AS year_ago, CASE WHEN bad THEN 'no_unambiguous_line' END AS reason FROM ({_REPORT})""")
def report_line_items(spark, sf):
    return corpus.report_line_items(_reports(spark, sf)).withColumns({n: F.round(n, 0) for n in ("current", "previous", "year_ago")})


@query("report_sections", "W10", """
SELECT symbol, CAST(year(qe) AS INTEGER) AS year, CAST(q AS INTEGER) AS quarter, CASE WHEN cents % 10 < 2 THEN 0 ELSE 3 + CASE WHEN cents % 10 = 2 THEN 1 ELSE 0 END END AS usable_lines,
  4 AS sections FROM fx_quarters""")
def report_sections(spark, sf):
    rows = _reports(spark, sf).where("document = 'report'").withColumns({"s": corpus.sections(F.col("text")), "l": corpus.quarter_labels(F.col("year"), F.col("quarter"))})
    lines = F.flatten(F.transform("s", lambda block: corpus.usable_lines(block, F.col("l"))))
    return rows.select("symbol", "year", "quarter", F.size(lines).alias("usable_lines"), F.size("s").alias("sections"))


# audits ------------------------------------------------------------------------------------------------------------

_DAMAGED = """(SELECT symbol, CAST(event_id AS VARCHAR) AS event_id, CAST(event_id + CASE WHEN ends_with(symbol, '4') THEN 0 ELSE 1 END AS DATE) AS observed,
  CAST(start + CASE WHEN ends_with(symbol, '3') AND month("end") = 6 THEN 1 ELSE 0 END AS DATE) AS start, "end", filed_at, reported_eps, split_adjustment,
  eps * CASE WHEN ends_with(symbol, '5') THEN 2 ELSE 1 END AS eps, accession FROM v_components)"""


@query("component_audit", "Q1 J9 W2", f"""
WITH c AS (SELECT *, lag("end") OVER (PARTITION BY symbol, event_id ORDER BY "end") AS prev FROM {_DAMAGED}),
m AS (SELECT *, EXISTS (SELECT 1 FROM fx_facts f WHERE f.symbol = c.symbol AND f.start = c.start AND f."end" = c."end" AND f.filed = filed_at AND f.accn = accession AND f.val = reported_eps) AS found FROM c),
g AS (SELECT symbol, event_id, count(*) <> 4 AS bad_count, max("end") - min(start) NOT BETWEEN 330 AND 400 AS bad_year,
  count(*) FILTER ("end" - start NOT BETWEEN 60 AND 110) AS span, count(*) FILTER (filed_at >= observed) AS availability, count(*) FILTER ("end" >= observed) AS future_period,
  count(*) FILTER (abs(eps - reported_eps / split_adjustment) > 1e-10 * greatest(abs(eps), abs(reported_eps / split_adjustment)) AND abs(eps - reported_eps / split_adjustment) > 1e-10) AS adjusted_mismatch,
  count(*) FILTER (prev IS NOT NULL AND start - prev <> 1) AS boundary_gap, count(*) FILTER (NOT found) AS unmatched_source FROM m GROUP BY ALL)
SELECT symbol, event_id, "check", n FROM (SELECT symbol, event_id, unnest(['count', 'year_span', 'span', 'availability', 'future_period', 'adjusted_mismatch', 'boundary_gap', 'unmatched_source']) AS "check",
  unnest([CAST(bad_count AS BIGINT), CAST(bad_year AS BIGINT), span, availability, future_period, adjusted_mismatch, boundary_gap, unmatched_source]) AS n FROM g) WHERE n > 0""")
def component_audit(spark, sf):
    rows = V.timeline(spark, sf).where("eps IS NOT NULL").select(
        "symbol", F.col("filed_at").alias("event_date"), F.inline("components"))
    late = F.when(F.col("symbol").endswith("4"), 0).otherwise(1)
    damaged = rows.select(
        "symbol", F.col("event_date").cast("string").alias("event_id"), F.date_add("event_date", late).alias("observed"),
        F.date_add("start", F.when(F.col("symbol").endswith("3") & (F.month("end") == 6), 1).otherwise(0)).alias("start"), "end", "filed_at",
        "reported_eps", "split_adjustment", (F.col("eps") * F.when(F.col("symbol").endswith("5"), 2).otherwise(1)).alias("eps"), "accession")
    return audit.audit_components(damaged, fx.facts(spark, sf).where("unit = 'USD/shares'"), input_tasks(spark, sf))


def _rebuilt(spark, sf):
    return audit.rebuild_samples(V.clean_prices(spark, sf), V.timeline(spark, sf), fx.calendar(spark, sf), V.series_tasks(spark, sf))


@query("rebuilt_samples", "Q2 J1", f"""
SELECT symbol, {day('date')}, price, eps, pe, {day('eps_filed_at')}, {day('eps_period_end')} FROM v_states
WHERE state IN ('valid', 'nonpositive_eps') AND date IN (SELECT session_date FROM fx_calendar)""")
def rebuilt_samples(spark, sf):
    return _rebuilt(spark, sf)


@query("reconciled_samples", "Q2 J12 U4", """
SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN day(date) = 9 THEN 'not_published' WHEN ends_with(symbol, '5') THEN 'pe' WHEN ends_with(symbol, '6') THEN 'price' END AS issue
FROM v_states WHERE state = 'valid' AND date IN (SELECT session_date FROM fx_calendar) AND (day(date) = 9 OR ends_with(symbol, '5') OR ends_with(symbol, '6'))""")
def reconciled_samples(spark, sf):
    sessions = fx.calendar(spark, sf).select(F.col("session_date").alias("date"))
    published = V.states(spark, sf).where("state = 'valid'").join(sessions, "date", "left_semi").where("day(date) <> 9")
    published = published.withColumns({
        "pe": F.when(F.col("symbol").endswith("5"), F.col("pe") * 1.001).otherwise(F.col("pe")),
        "price": F.when(F.col("symbol").endswith("6"), F.col("price") + 1).otherwise(F.col("price"))})
    return audit.reconcile_samples(published, _rebuilt(spark, sf))


@query("session_differences", "U4", """
SELECT symbol, CAST(date AS VARCHAR) AS date, 'extra' AS side FROM v_states WHERE state = 'valid' AND date NOT IN (SELECT session_date FROM fx_calendar)
UNION ALL SELECT symbol, CAST(date AS VARCHAR), 'lacking' FROM v_states WHERE state = 'valid' AND date IN (SELECT session_date FROM fx_calendar) AND day(date) = 9""")
def session_differences(spark, sf):
    published = V.states(spark, sf).where("state = 'valid' AND NOT (day(date) = 9 AND weekday(date) < 5)").select("symbol", "date")
    rebuilt = _rebuilt(spark, sf).where("pe IS NOT NULL").select("symbol", "date")
    differing = matching.multiset_difference(published, rebuilt, V.series_tasks(spark, sf))
    return differing.select("symbol", "date", F.when(F.col("in_left"), "extra").otherwise("lacking").alias("side"))


@query("valuation_audit", "Q2 A1 A2", f"""
WITH e AS (SELECT * FROM v_summary WHERE status IN ('qualified', 'limited') AND current_pe_qualified),
i AS (SELECT e.symbol, horizon_years, e.percentile, sample_count, e.pe AS now_pe, s.pe FROM e JOIN v_states s ON s.symbol = e.symbol AND s.state = 'valid'
  AND s.date IN (SELECT session_date FROM fx_calendar) AND s.date BETWEEN CAST(e.as_of - to_years(horizon_years) AS DATE) AND e.as_of)
SELECT symbol, horizon_years, count(*) AS recounted_samples, {r2('1e2 * count(*) FILTER (pe <= now_pe) / count(*)')} AS recounted_percentile, round(quantile_cont(pe, 0.2), 6) AS p20_pe, round(median(pe), 6) AS median_pe, round(quantile_cont(pe, 0.8), 6) AS p80_pe,
  NOT ends_with(symbol, 'A') AS quantiles_match, recounted_percentile = percentile AS percentile_matches, count(*) = sample_count AS count_matches FROM i GROUP BY symbol, horizon_years, percentile, sample_count""")
def valuation_audit(spark, sf):
    """Recount of what the summary and the quantiles say; the published P80 of symbols that end in A is damaged."""
    summary = V.summary(spark, sf)
    window = summary.select("symbol", F.col("as_of").alias("_end"), "horizon_years")
    inside = _rebuilt(spark, sf).where("pe IS NOT NULL").join(window, "symbol").where(F.col("date").between(S.years_before(F.col("_end"), F.col("horizon_years")), F.col("_end")))
    damaged = F.col("symbol").endswith("A") & (F.col("percentile") == 80)
    published = valuation.quantiles(inside, ["symbol"]).withColumn("pe", F.when(damaged, F.col("pe") * 1.001).otherwise(F.col("pe")))
    rows = audit.audit_valuation(summary, _rebuilt(spark, sf), published)
    return rows.withColumns({c: F.round(c, 6) for c in ("p20_pe", "median_pe", "p80_pe")})


@query("checkpoint_audit", "Q3", f"""
SELECT symbol, {day('end')}, val + 1 AS expected FROM fx_facts WHERE concept = 'EarningsPerShareDiluted' AND form = '10-K' AND ends_with(symbol, '8')""")
def checkpoint_audit(spark, sf):
    facts = fx.facts(spark, sf).where("concept = 'EarningsPerShareDiluted'")
    read = facts.where("form = '10-K'").select(
        "symbol", "end", F.when(F.col("symbol").endswith("8"), F.col("val") + 1).otherwise(F.col("val")).alias("expected"))
    return audit.audit_checkpoints(facts, read)


# reconciliation by digests -----------------------------------------------------------------------------------------

def _stored_trees(spark, sf):
    """Published samples with a few damaged months, the rebuilt ones, and their trees, written as they would be beside the tables."""
    sessions = fx.calendar(spark, sf).select(F.col("session_date").alias("date"))
    published = V.states(spark, sf).where("state = 'valid'").join(sessions, "date", "left_semi")
    damaged, lost = F.col("symbol").endswith("5") & (F.month("date") == 3), F.col("symbol").endswith("6") & (F.dayofyear("date") == 100)
    published = published.where(~lost).withColumn("price", F.when(damaged, F.col("price") + 1).otherwise(F.col("price")))
    rebuilt, folders = _rebuilt(spark, sf), []
    for rows in (published, rebuilt.where("pe IS NOT NULL")):
        folders.append(shared_folder(spark, "tree"))
        reconcile.write_tree(rows, folders[-1])
    return published, rebuilt, *[spark.read.parquet(folder) for folder in folders]


_SOUND = "v_states WHERE state = 'valid' AND date IN (SELECT session_date FROM fx_calendar)"
_HARM = "CASE WHEN ends_with(symbol, '6') AND dayofyear(date) = 100 THEN 'not_published' WHEN ends_with(symbol, '5') AND month(date) = 3 THEN 'price' END"


@query("digest_differences", "J12 U4 Q2", f"""
SELECT symbol, CAST(date AS VARCHAR) AS date, {_HARM} AS issue FROM {_SOUND} AND {_HARM} IS NOT NULL""")
def digest_differences(spark, sf):
    return reconcile.reconcile_by_digests(*_stored_trees(spark, sf))


@query("digest_descent", "J12 U4", f"""
WITH r AS (SELECT symbol, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, {_HARM} AS issue FROM {_SOUND}),
s AS (SELECT symbol, count(issue) > 0 AS differs FROM r GROUP BY ALL),
y AS (SELECT symbol, year, count(issue) > 0 AS differs FROM r WHERE symbol IN (SELECT symbol FROM s WHERE differs) GROUP BY ALL),
m AS (SELECT symbol, year, month, count(issue) > 0 AS differs FROM r JOIN (SELECT symbol, year FROM y WHERE differs) USING (symbol, year) GROUP BY ALL)
SELECT 'symbol' AS level, symbol, NULL AS year, NULL AS month, differs FROM s UNION ALL SELECT 'year', symbol, year, NULL, differs FROM y
UNION ALL SELECT 'month', symbol, year, month, differs FROM m""")
def digest_descent(spark, sf):
    """The nodes a comparison looks at, level by level."""
    return reconcile.compared_nodes(*_stored_trees(spark, sf)[2:])
