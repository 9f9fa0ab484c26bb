from __future__ import annotations

import hashlib

from conftest import d, fact, facts, only

from plumbline.operators import audit, corpus

HEAD = "(In NT$ billions) 3Q27 2Q27 3Q26"
REPORT = ["Overview of the quarter", "I. Operating Income Analysis", HEAD, "Operating Income 91.20 88.05 70.40", "II - 1. Quarterly Cash Flow Analysis", HEAD,
          "Net Operating   Sources/(Uses) 140.50 120.25 (3.10)", "Capital Expenditures (60.00) (55.50) (48.75)", "III. Notes", "Capital Expenditures 1.00 2.00 3.00"]
RELEASE = ("KEELUNG, October 14, 2027 (Newsroom) -- Results for the three months to September 30, 2027 were approved today. Revenue reached NT$84.10 billion; in dollar "
           "terms revenue was US$2.605 billion. Net profit came to NT$12.4 billion against NT$11 billion. Diluted EPS was NT$3.10 (US$0.48 for each ADR).")
KEYS = "symbol string, year int, quarter int, document string, text string"


def lines(spark, *reports):
    rows = [("KEEL", 2027, 3, name, "\r\n".join(text)) for name, text in reports]
    return {(r["document"], r["metric"]): r for r in corpus.report_line_items(spark.createDataFrame(rows, KEYS)).collect()}


def test_report_lines_keep_currency_sign_and_section(spark):
    rows = lines(spark, ("full", REPORT), ("cover", REPORT[:2] + REPORT[4:5] + REPORT[6:7]))
    cash, capex, income = (rows["full", m] for m in ("operating_cash_flow", "capex", "operating_income"))
    assert [cash[c] for c in ("current", "previous", "year_ago")] == [140.5e9, 120.25e9, -3.1e9]
    assert (capex["current"], capex["reason"], income["year_ago"]) == (-60e9, None, 70.4e9)
    assert {r["reason"] for (document, _), r in rows.items() if document == "cover"} == {"no_unambiguous_line"}


def test_report_lines_are_withheld_when_in_doubt(spark):
    def reason(metric, change):
        return lines(spark, ("r", [change(x) for x in REPORT]))["r", metric]["reason"]

    same = lambda x: x
    assert reason("capex", same) is None
    assert reason("capex", lambda x: x.replace("3Q27 2Q27", "2Q27 3Q27")) == "no_unambiguous_line"
    assert reason("capex", lambda x: x.replace("billions", "millions")) == "no_unambiguous_line"
    assert reason("capex", lambda x: x.replace("(60.00)", "60.00")) == "no_unambiguous_line"
    assert reason("operating_income", lambda x: x.replace("Overview of the quarter", "I. Operating Income Analysis\n" + HEAD + "\nOperating Income 1.00 2.00 3.00")) == "no_unambiguous_line"
    assert reason("operating_income", lambda x: x.replace("Overview of the quarter", "Operating Income 1.00 2.00 3.00")) is None


def release(spark, text, quarter=3):
    return only(corpus.release_facts(spark.createDataFrame([("KEEL", 2027, quarter, text)], "symbol string, year int, quarter int, text string")))


def test_release_figures(spark):
    row = release(spark, RELEASE)
    assert (row["eps"], row["eps_native"], row["end"], row["filed"]) == (0.48, 3.1, d("2027-09-30"), d("2027-10-14"))
    assert (row["revenue_native"], row["income_native"], row["revenue_usd"]) == (84.1e9, 12.4e9, 2.605e9)
    layout = release(spark, RELEASE.replace("84.10", "84. 10").replace("US$0.48", "US$ 0. 48"))
    assert (layout["revenue_native"], layout["eps"]) == (84.1e9, 0.48)
    millions = release(spark, RELEASE.replace("US$2.605 billion", "US$2,605 million"))
    assert millions["revenue_usd"] == 2.605e9


def test_release_dates_may_stand_anywhere(spark):
    front = "Readers may compare the notes of May 4, 2011 and the tables. " * 60
    assert release(spark, front + RELEASE)["filed"] == d("2027-10-14")
    assert release(spark, RELEASE, quarter=2)["reason"] == "dates_not_reconciled"
    assert release(spark, RELEASE.replace("October 14, 2027", "February 14, 2028"))["reason"] == "dates_not_reconciled"
    assert release(spark, RELEASE.replace(" (Newsroom) --", ","))["reason"] == "dates_not_reconciled"
    assert release(spark, RELEASE.replace("for each ADR", "for each ordinary share"))["reason"] == "no_usd_eps"


def page(spark, html):
    return spark.createDataFrame([(1, "http://e.org/", html)], "page_id long, url string, html string")


def test_page_text_and_assets(spark):
    html = ("<title>T &amp; U</title><style>p{}</style><script>var ct = '1';</script><p>one&nbsp; two</p><div>three<br>four</div>\n\n\n<p></p><p>five &amp;lt;</p>"
            "<a href='x.htm#top'>l</a><a href='#only'>n</a><img src='data:image/svg+xml,z' data-src='https://e.org/i.png#f' alt='A'><noscript>no</noscript>")
    pages = page(spark, html)
    assert only(corpus.page_text(pages))["text"] == "T & Uone two\nthree\nfour\n\nfive &lt;\nln"
    assert [r["link"] for r in corpus.page_links(pages).collect()] == ["x.htm"]
    image = only(corpus.page_images(pages))
    assert (image["source_url"], image["alt"], image["status"]) == ("https://e.org/i.png", "A", "listed")
    assert only(corpus.page_metadata(pages))["title"] == "T & U"


def test_quotes_entities_and_nesting_as_a_browser_reads_them(spark):
    html = ("<meta name=\"author\" content=\"O'Neil\"><h1 class=x id=\"activity-name\"><span>A</span> B</h1><a data-href='/no' href=\"/q?it's\">l</a><a href=/plain>p</a>"
            "<img src=\"a'b.png\" alt='x > y'><p title='1>0'>It&#8217;s &#x41; &eacute; &nope; &#0;&#150;</p>")
    meta = only(corpus.page_metadata(page(spark, html)))
    assert (meta["author"], meta["title"]) == ("O'Neil", "A B")
    assert [r["link"] for r in corpus.page_links(page(spark, html)).collect()] == ["/q?it's", "/plain"]
    image = only(corpus.page_images(page(spark, html)))
    assert (image["source_url"], image["alt"]) == ("a'b.png", "x > y")
    assert "It\u2019s A \u00e9 &nope; \ufffd\u2013" in only(corpus.page_text(page(spark, html)))["text"]


def test_elements_close_at_their_own_depth(spark):
    def author(html):
        return only(corpus.page_metadata(page(spark, html)))["author"]

    assert author("<div id=js_name><div>A</div> B</div> C") == "A B"
    assert author("<DIV id='js_name'><div><div>A</div></div><DIV >B</div >C</div></div>D") == "A B C"
    assert author("<div id=js_name>A<span>B</div>C</span>") == "A B"  # crossed by another name
    assert author("<div id=js_name><div>A</div> B<p>C") == "A B C"  # never closed
    assert author("<p id=js_name>A <b>B</b><p>C</p>") == "A B"  # cannot hold its own kind
    assert author("<input id=js_name>A</input>") is None
    assert author("<!-- <i id=js_name>no</i> --><i id=js_name>A<!-- </i> --><script>'</i>'</script> B</i> C") == "A B"
    assert author("<ul id=js_name><li>A<ul><li title='</ul>'>B</ul><li>C</ul>D") == "A B C"
    assert author("") is None and author(None) is None
    deep = "<div>" * 500 + "A" + "</div>" * 500
    assert author(f"<div id=js_name>{deep} B</div> C") == "A B"


def test_nested_templates_are_hidden_whole(spark):
    def text(html):
        return only(corpus.page_text(page(spark, html)))["text"]

    assert text("a<template>b<template>c</template>d</template>e</template>f") == "aef"
    assert text("a<template>b<TEMPLATE x='>'>c</template>d") == "abcd"  # never closed
    assert text("a<template>b<!-- </template> -->c</template>d") == "ad"


COMPONENTS = "symbol string, event_id string, observed date, start date, end date, filed_at date, reported_eps double, split_adjustment double, eps double, accession string"
# Quarters of thirteen weeks of a company that split 5 for 2 in between: (start, end, filed, reported, factor, adjusted, accession).
WEEKS = [
    ("2032-01-04", "2032-04-03", "2032-05-11", 1.75, 2.5, 0.7, "w-1"), ("2032-04-04", "2032-07-03", "2032-08-10", -0.5, 2.5, -0.2, "w-2"),
    ("2032-07-04", "2032-10-02", "2032-11-09", 0.85, 1.0, 0.85, "w-3"), ("2032-10-03", "2033-01-01", "2033-03-01", 1.1, 1.0, 1.1, "w-4"),
]


def violations(spark, used=WEEKS, filed=WEEKS, observed="2033-03-02"):
    used = [("X", "e", d(observed), *(d(x) for x in r[:3]), *r[3:]) for r in used]
    source = [fact(*r[:2], r[3], r[2], accn=r[6], concept="EarningsPerShareDiluted", unit="USD/shares") for r in filed]
    source = facts(spark, *source, fact("1999-01-03", "1999-04-03", 9))
    return {r["check"] for r in audit.audit_components(spark.createDataFrame(used, COMPONENTS), source).collect()}


def with_quarter(index, **changes):
    names = ("start", "end", "filed", "reported", "factor", "adjusted", "accession")
    return [tuple(changes.get(n, v) for n, v in zip(names, r)) if i == index else r for i, r in enumerate(WEEKS)]


def test_each_component_check_finds_its_fault(spark):
    assert violations(spark) == set()
    assert violations(spark, with_quarter(1, adjusted=-0.5)) == {"adjusted_mismatch"}
    assert violations(spark, with_quarter(2, reported=0.9, adjusted=0.9)) == {"unmatched_source"}
    assert violations(spark, with_quarter(2, accession="w-9")) == {"unmatched_source"}
    assert violations(spark, filed=WEEKS[:3]) == {"unmatched_source"}
    assert violations(spark, observed="2033-02-28") == {"availability"}
    assert violations(spark, with_quarter(1, start="2032-04-06")) == {"boundary_gap", "unmatched_source"}
    assert violations(spark, WEEKS[:3]) == {"count", "year_span"}


def test_a_split_factor_must_be_a_positive_number(spark):
    for factor in (0.0, -2.5, None, float("nan")):
        assert "bad_factor" in violations(spark, with_quarter(0, factor=factor)), factor


def content_issues(spark, **items):
    """items: name to (stored, listed); names have `_` for the dot."""
    rows = [(name.replace("_", "."), stored, listed) for name, (stored, listed) in items.items()]
    manifest = spark.createDataFrame([(n, len(x), hashlib.sha256(x).hexdigest()) for n, _, x in rows], "item string, bytes long, sha256 string")
    content = spark.createDataFrame([(n, bytearray(x)) for n, x, _ in rows], "item string, content binary")
    found = {n: set() for n, _, _ in rows}
    for r in audit.verify_content(manifest, content).collect():
        found[r["item"]].add(r["issue"])
    return {n.replace(".", "_"): v for n, v in found.items()}


def test_archived_content_is_checked_by_digest_and_kind(spark):
    note = "<main>Umsatz 84 Mio.\nLager: gering</main>".encode()
    picture, frame = b"\x89PNG\r\n\x1a\n" + bytes(9), b"RIFF" + bytes(4) + b"WEBPVP8 "
    drawing = b"<!--" + b"-" * 5000 + b"--><svg width='3'/>"
    expected = {
        "same_html": (note, note, set()), "ends_html": (note.replace(b"\n", b"\r\n"), note, {"byte_count", "hash_by_text_basis"}),
        "figure_html": (note.replace(b"84", b"48"), note, {"sha256"}), "bytes_html": (note + b"\xc3", note, {"byte_count", "sha256", "bad_encoding"}),
        "good_png": (picture, picture, set()), "page_png": (note, note, {"bad_signature"}), "good_webp": (frame, frame, set()),
        "good_svg": (drawing, drawing, set()), "text_svg": (b"<b>" + drawing, b"<b>" + drawing, {"bad_signature"}),
    }
    found = content_issues(spark, **{n: v[:2] for n, v in expected.items()})
    assert found == {n: v[2] for n, v in expected.items()}
    whole = b"<!doctype html><html>moved</html>"
    assert content_issues(spark, moved_png=(whole, whole)) == {"moved_png": {"bad_signature", "html_as_image"}}


def test_sensitive_scan_reports_where(spark):
    rows = [("a.txt", "nothing", 7), (".env", "x", 1), (".env.example", "x", 1), ("key.PEM", "x", 1), ("b.txt", "AKIA" + "A" * 16, 20), ("c.txt", "the Acme shop; acmeology", 9),
            ("d.txt", "acmeology", 9), ("logs/x", "y", 1)]
    df = spark.createDataFrame(rows, "path string, text string, size long")
    found = sorted((r["path"], r["issue"]) for r in audit.scan_sensitive(df, "path", "text", "size", brands=("acme",)).collect())
    assert found == [(".env", "forbidden_path"), ("b.txt", "credential"), ("c.txt", "brand_in_text"), ("key.PEM", "forbidden_path"), ("logs/x", "forbidden_path")]


def test_a_damaged_quantile_is_found(spark):
    days = [(s, d(f"2031-{m:02d}-15"), float(v)) for s in ("AB", "CD", "EF") for m, v in enumerate((9, 30, 14, 22, 17), 1)]
    rebuilt = spark.createDataFrame([*days, ("AB", d("2028-01-05"), 99.0), ("AB", d("2031-06-02"), None)], "symbol string, date date, pe double")
    summary = spark.createDataFrame(
        [(s, "qualified", True, d("2031-12-31"), 3, 17.0, 60.0, 5) for s in ("AB", "CD", "EF")],
        "symbol string, status string, current_pe_qualified boolean, as_of date, horizon_years int, pe double, percentile double, sample_count int")
    quantiles = {20: 13.0, 50: 17.0, 80: 23.6}
    published = [(s, p, v * (1.0001 if (s, p) == ("CD", 20) else 1)) for s in ("AB", "CD") for p, v in quantiles.items()]
    rows = audit.audit_valuation(summary, rebuilt, spark.createDataFrame(published, "symbol string, percentile int, pe double")).collect()
    assert {r["symbol"]: r["quantiles_match"] for r in rows} == {"AB": True, "CD": False, "EF": None}
    assert all(r["percentile_matches"] and r["count_matches"] for r in rows)
    assert {(round(r["p20_pe"], 9), r["median_pe"], round(r["p80_pe"], 9)) for r in rows} == {(13.0, 17.0, 23.6)}
