from __future__ import annotations

import json
import re
from urllib.parse import unquote

import pytest
from conftest import d, only

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import directory, quotes
from plumbline.sources import readers
from plumbline.sources.versions import Table
from plumbline.streaming import streams


def write(path, *documents):
    path.write_text("\n".join(json.dumps(x) for x in documents), encoding="utf-8")
    return str(path)


def test_company_facts_file(spark, tmp_path):
    good = {"start": "2026-01-01", "end": "2026-03-31", "filed": "2026-05-01", "form": "10-Q", "accn": "a", "val": 5}
    bad = {**good, "start": "2026-13-01"}
    balance = {"end": "2026-03-31", "filed": "2026-05-01", "form": "10-Q", "accn": "b", "val": "7"}
    path = write(tmp_path / "f.json", {"symbol": "X", "facts": {"us-gaap": {"Revenues": {"units": {"USD": [good, bad]}}, "StockholdersEquity": {"units": {"USD": [balance]}}}}})
    rows = {r["concept"]: r for r in readers.read_company_facts(spark, path).collect()}
    assert rows["Revenues"]["val"] == 5 and rows["Revenues"]["start"] == d("2026-01-01") and rows["Revenues"]["pos"] == 0
    assert rows["StockholdersEquity"]["start"] is None and rows["StockholdersEquity"]["val"] == 7


def test_prices_keep_the_last_row_of_a_date(spark, tmp_path):
    rows = [{"symbol": "X", "date": "09/04/2026", "close": "$1,100.50", "pos": 1}, {"symbol": "X", "date": "09/04/2026", "close": "$1,101.00", "pos": 2},
            {"symbol": "X", "date": "2026-09-05", "close": "$1", "pos": 3}]
    row = only(readers.read_prices(spark, write(tmp_path / "p.json", *rows)))
    assert (row["date"], row["close"]) == (d("2026-09-04"), 1101)


def test_filings_pad_short_arrays(spark, tmp_path):
    payload = {"symbol": "X", "cik": "1", "form": ["10-Q", "8-K"], "accessionNumber": ["a-1", "a-2"], "filingDate": ["2026-07-30", "2026-08-01"], "reportDate": ["2026-06-30"],
               "primaryDocument": ["q.htm"], "items": []}
    rows = sorted(readers.read_filings(spark, write(tmp_path / "s.json", payload)).collect(), key=lambda r: r["accession"])
    assert [r["items"] for r in rows] == ["", ""] and rows[1]["document"] == "" and rows[1]["report_date"] is None


def test_catalog_accepts_a_map_or_a_list(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"0": {"ticker": "aapl", "title": "APPLE INC.", "cik_str": 320193}, "1": {"ticker": "", "title": "x", "cik_str": 1}}))
    (tmp_path / "b.json").write_text(json.dumps([{"ticker": "amzn", "title": "AMAZON COM INC", "cik_str": 1018724}]))
    rows = {r["symbol"]: r for r in readers.read_catalog(spark, str(tmp_path)).collect()}
    assert rows["AAPL"]["cik"] == "0000320193" and rows["AMZN"]["name"] == "Amazon Com Inc" and len(rows) == 2
    catalog = readers.read_catalog(spark, str(tmp_path))
    assert directory.search_catalog(catalog, "aws").first()["symbol"] == "AMZN"


def test_supplements_keep_the_last_of_a_period(spark, tmp_path):
    quarter = {"start": "2026-01-01", "end": "2026-03-31", "filed": "2026-05-01", "form": "8-K", "accn": "a", "val": 1}
    path = write(tmp_path / "q.json", {"symbol": "X", "quarters": [quarter, {**quarter, "val": 2}]})
    assert only(readers.read_supplements(spark, path))["val"] == 2


def test_report_folder_reads_whole_pages(spark, tmp_path):
    (tmp_path / "one.html").write_text("<p>a</p>\n<p>b</p>")
    row = only(readers.read_reports(spark, str(tmp_path)))
    assert row["html"] == "<p>a</p>\n<p>b</p>"


def test_provider_shaped_documents(spark, tmp_path):
    """As the providers send them: nested, one document per file, printed over many lines."""
    def pretty(name, document):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps(document, indent=2), encoding="utf-8")
        return str(path)

    item = {"start": "2029-01-01", "end": "2029-03-31", "filed": "2029-05-02", "form": "10-Q", "accn": "k-1"}
    units = {"USD": [{**item, "val": 7}, {**item, "val": 9.5, "accn": "k-2"}], "EUR": [{**item, "val": 1}]}
    path = pretty("facts/KOLB.json", {"cik": 4711, "entityName": "Kolb", "facts": {"us-gaap": {"Revenues": {"label": "R", "units": units}}}})
    known = spark.createDataFrame([("0000004711", "KOLB")], "cik string, symbol string")
    rows = readers.read_company_facts(spark, path, known).collect()
    assert sorted((r["symbol"], r["unit"], r["pos"], r["val"], r["accn"]) for r in rows) == [
        ("KOLB", "EUR", 0, 1.0, "k-1"), ("KOLB", "USD", 0, 7.0, "k-1"), ("KOLB", "USD", 1, 9.5, "k-2")]
    assert {r["symbol"] for r in readers.read_company_facts(spark, path).collect()} == {None}

    table = {"rows": [{"date": "03/18/2029", "close": "$1,204.50"}, {"date": "03/19/2029", "close": "$7"}, {"date": "03/19/2029", "close": "$8"}]}
    path = pretty("prices/prices-RIND.json", {"data": {"tradesTable": table}, "status": {"rCode": 200}})
    assert sorted((r["symbol"], str(r["date"]), r["close"]) for r in readers.read_prices(spark, path).collect()) == [("RIND", "2029-03-18", 1204.5), ("RIND", "2029-03-19", 8.0)]

    for inner in ([{"symbol": "kolb", "last": "3"}], {"symbol": "kolb", "last": "3"}):
        path = write(tmp_path / "q.json", {"captured_at": "2029-03-19T10:00:00", "quotes": json.dumps({"FormattedQuoteResult": {"FormattedQuote": inner}})})
        assert [(r["symbol"], r["price"]) for r in readers.read_quotes(spark, path).collect()] == [("KOLB", 3.0)]

    recent = {"accessionNumber": ["a", "b"], "form": ["10-Q", "8-K"], "filingDate": ["2029-05-02"], "reportDate": [], "primaryDocument": ["d.htm"], "items": []}
    path = pretty("filings/f.json", {"cik": "4711", "tickers": ["KOLB", "KLB"], "filings": {"recent": recent, "files": []}})
    rows = sorted((r["symbol"], r["accession"], r["form"], r["items"]) for r in readers.read_filings(spark, path).collect())
    assert rows == [("KOLB", "a", "10-Q", ""), ("KOLB", "b", "8-K", "")]

    shard = {"symbol": "KOLB", "cik": "4711", "accessionNumber": ["old"], "form": ["10-K"], "filingDate": ["2020-01-02"], "reportDate": [""], "primaryDocument": [""], "items": [""]}
    for to in ("2020-12-31", "2015-12-31"):
        (tmp_path / "shards" / f"filing_to={to}").mkdir(parents=True)
        write(tmp_path / "shards" / f"filing_to={to}" / "s.json", {**shard, "accessionNumber": [to]})
    archive = readers.read_filing_archive(spark, path, str(tmp_path / "shards"), "2018-01-01")
    assert sorted(r["accession"] for r in archive.collect()) == ["2020-12-31", "a", "b"]
    assert "PartitionFilters: [isnotnull(filing_to" in archive._jdf.queryExecution().executedPlan().toString()


def test_archive_shards_without_keys_get_those_of_the_recent_document(spark, tmp_path):
    arrays = {"accessionNumber": ["x-1"], "form": ["10-K"], "filingDate": ["2020-01-02"], "reportDate": [""], "primaryDocument": [""], "items": [""]}
    recent = write(tmp_path / "recent.json", {"cik": "0000004711", "tickers": ["KOLB"], "filings": {"recent": {**arrays, "accessionNumber": ["new"]}}})
    folder = tmp_path / "shards" / "filing_to=2020-12-31"
    folder.mkdir(parents=True)
    write(folder / "CIK0000004711-submissions-001.json", {**arrays, "accessionNumber": ["old"]})
    write(folder / "CIK0000000099-submissions-001.json", {**arrays, "accessionNumber": ["lone"]})
    rows = readers.read_filing_archive(spark, recent, str(tmp_path / "shards"), "2018-01-01").collect()
    assert sorted((r["accession"], r["symbol"], r["cik"]) for r in rows) == [("lone", None, "99"), ("new", "KOLB", "0000004711"), ("old", "KOLB", "0000004711")]


def test_lines_and_documents_are_told_apart_and_bad_records_reported(spark, tmp_path):
    folder = tmp_path / "in put %41"
    folder.mkdir()
    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("n", T.LongType())])
    (folder / "lines.json").write_text('not json at all\n{"symbol": "A", "n": 1}\n\n  \n{"symbol": "B", "n": 2, "more": [1]}\n{"symbol": "C", "n": \n{"symbol": "D", "n": 4}\n{"symbol": "E"}\n')
    (folder / "one.json").write_text(json.dumps({"symbol": "F", "n": 6}, indent=1))
    (folder / "list[1].json").write_text('[\n{"symbol": "G", "n": 7},\n{"symbol": "H", "n": 8}\n]')
    (folder / "cut.json").write_text('{\n "symbol": "I",\n "n": ')
    (folder / "single.json").write_text('{"symbol": "J", "n": 10}')
    (folder / "empty.json").write_text("")
    found = readers.json_documents(spark, str(folder), schema)
    rows = readers.good(found).select("symbol", "n").collect()
    assert sorted(tuple(r) for r in rows if r["n"] is not None) == [("A", 1), ("B", 2), ("D", 4), ("F", 6), ("G", 7), ("H", 8), ("J", 10)]
    assert [r["symbol"] for r in rows if r["n"] is None] == ["E"]
    bad = {(r["path"].rsplit("/", 1)[1], r["bad"]) for r in readers.bad_records(found).collect()}
    assert bad == {("lines.json", "not json at all"), ("lines.json", '{"symbol": "C", "n": '), ("cut.json", '{\n "symbol": "I",\n "n": ')}
    kinds = {unquote(r["path"]).rsplit("/", 1)[1]: r["per_line"] for r in readers.file_layouts(spark, str(folder)).collect()}
    assert kinds == {"lines.json": True, "single.json": True, "one.json": False, "list[1].json": False, "cut.json": False}
    assert readers.json_documents(spark, str(folder / "lines.json"), schema, "lines").count() == 6
    assert readers.good(readers.json_documents(spark, str(folder / "list*.json"), schema, "documents")).count() == 2


def test_folders_of_one_kind_are_read_as_folders(spark, tmp_path):
    """However many companies have a file of their own, the driver is not handed each of them."""
    root, schema = tmp_path / "in put %41", T.StructType([T.StructField("n", T.LongType())])
    for name in ("documents/a[1]", "documents/b", "lines", "both/deep", "both/more"):
        (root / name).mkdir(parents=True)
    for n in range(10):
        (root / "documents" / ("a[1]" if n % 2 else "b") / f"{n}.json").write_text(json.dumps({"n": n}, indent=1))
    (root / "documents" / "b" / "blank.json").write_text("\n \n")
    for n in (10, 12):
        write(root / "lines" / f"{n}.json", {"n": n}, {"n": n + 1})
    write(root / "both" / "l.json", {"n": 14}, {"n": 15})
    (root / "both" / "d.json").write_text(json.dumps([{"n": 16}, {"n": 17}], indent=1))
    (root / "both" / "deep" / "d.json").write_text(json.dumps({"n": 18}, indent=1))
    write(root / "both" / "more" / "l.json", {"n": 19}, {"n": 20})
    write(root / "both" / "l.txt", {"n": 99})

    def read(path):
        found = readers.json_documents(spark, path, schema)
        plan = found._jdf.queryExecution().executedPlan().toString()
        return sorted(r["n"] for r in found.select("d.n").collect()), sorted(int(n) for n in re.findall(r"InMemoryFileIndex\((\d+) paths\)", plan))

    assert read(str(root)) == ([*range(21), 99], [3, 4])  # documents, both/d.json, both/deep; lines, both/l.json, both/l.txt, both/more
    assert read(str(root / "documents")) == ([*range(10)], [1])
    assert read(str(root / "lines") + "/") == ([10, 11, 12, 13], [1])
    assert read(str(root / "documents" / "b" / "*.json")) == ([0, 2, 4, 6, 8], [6])  # Spark lists what a pattern names
    assert read(str(root / "both" / "*.json")) == ([14, 15, 16, 17], [1, 1])  # and not what stands beside it


def test_a_line_file_is_split(spark, tmp_path):
    schema = T.StructType([T.StructField("n", T.LongType())])
    (tmp_path / "big.json").write_text("".join(f'{{"n": {i}, "pad": "{"x" * 200}"}}\n' for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        found = readers.good(readers.json_documents(spark, str(tmp_path / "big.json"), schema))
        assert found.rdd.getNumPartitions() > 4 and found.agg(F.sum("n")).first()[0] == 199_990_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_pretty_printed_quote_payload_is_read(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"captured_at": "2029-03-19T10:00:00", "quotes": [{"symbol": "kolb", "last": "3"}]}, indent=2))
    assert only(readers.read_quotes(spark, str(tmp_path / "q.json")))["price"] == 3


def test_pages_with_bad_bytes_are_read(spark, tmp_path):
    (tmp_path / "p.html").write_bytes(b"<p>ok \xff end</p>")
    assert only(readers.read_reports(spark, str(tmp_path)))["html"] == "<p>ok \ufffd end</p>"


def quote_file(tmp_path, name, at, *items):
    return write(tmp_path / name, {"captured_at": at, "quotes": json.dumps(items[0] if len(items) == 1 else list(items))})


def arrived(spark, folder):
    rows = readers.stream_quotes(spark, str(folder))
    return rows.withColumns({"valid": F.coalesce(rows["price"] > 0, F.lit(False)), "event_id": F.lit(0)})


def test_quote_history_takes_late_quotes_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        streams.append_quotes(arrived(spark, folder), out, checkpoint, buckets=2).awaitTermination()
        return sorted((r["symbol"], str(r["captured_at"])[:10], r["price"]) for r in Table(spark, out).read().collect())

    quote_file(folder, "1.json", "2026-03-19T10:00:00", {"symbol": "kolb", "last": "12.5"}, {"symbol": "RIND", "last": "--"})
    assert run() == [("KOLB", "2026-03-19", 12.5)]
    quote_file(folder, "2.json", "2026-03-19T10:00:00", {"symbol": "KOLB", "last": "99"})
    quote_file(folder, "3.json", "2019-01-02T10:00:00", {"symbol": "rind", "last": "4"})
    assert run() == [("KOLB", "2026-03-19", 12.5), ("RIND", "2019-01-02", 4.0)]


def test_stream_state_records_errors_and_keeps_the_price(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    path, checkpoint = str(tmp_path / "state"), str(tmp_path / "cp")
    seen = []
    for name, at, text in (("1", "2026-03-19T10:00:00", "7"), ("2", "2026-03-19T11:00:00", "n/a"), ("3", "2026-03-18T09:00:00", "5"), ("4", "2026-03-19T12:00:00", "8")):
        quote_file(folder, f"{name}.json", at, {"symbol": "KOLB", "last": text})
        streams.upsert_quotes(arrived(spark, folder), path, checkpoint).awaitTermination()
        row = Table(spark, path).read().collect()
        assert len(row) == 1
        seen.append((row[0]["price"], row[0]["error"]))
    assert seen == [(7.0, None), (7.0, quotes.INVALID_PRICE), (7.0, quotes.INVALID_PRICE), (8.0, None)]


def test_bad_and_missing_quotes_keep_the_price(spark):
    state = "symbol string, price double, quote_at timestamp, error string"
    previous = spark.createDataFrame([("A", 1.0, None, None), ("B", 2.0, None, None), ("C", 3.0, None, "old")], state)
    batch = spark.sql("""SELECT * FROM VALUES ('A', timestamp'2026-01-01 00:00:00', 1L, double(null), false), ('C', timestamp'2026-01-01 00:00:00', 2L, double(9), true)
      AS t(symbol, captured_at, event_id, price, valid)""")
    rows = {r["symbol"]: (r["price"], r["error"]) for r in quotes.last_good_quotes(previous, batch).collect()}
    assert rows == {"A": (1.0, quotes.INVALID_PRICE), "B": (2.0, quotes.NO_QUOTE), "C": (9.0, None)}


def test_filing_stream_keeps_late_filings_and_when_they_were_found(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    path, checkpoint, log = str(tmp_path / "events"), str(tmp_path / "cp"), str(tmp_path / "log")

    def run():
        stream = spark.readStream.schema("symbol string, accession string, filed date").json(str(folder))
        streams.append_filings(stream, path, checkpoint, lambda n: F.lit(n), buckets=2).awaitTermination()
        return sorted((r["symbol"], r["accession"], r["discovered_at"]) for r in Table(spark, path).read().collect())

    write(folder / "1.json", {"symbol": "KOLB", "accession": "n-1", "filed": "2026-02-11"}, {"symbol": "KOLB", "accession": "n-1", "filed": "2026-02-11"})
    assert run() == [("KOLB", "n-1", 0)]
    write(folder / "2.json", {"symbol": "RIND", "accession": "o-1", "filed": "2014-05-06"}, {"symbol": "KOLB", "accession": "n-1", "filed": "2026-02-11"})
    assert run() == [("KOLB", "n-1", 0), ("RIND", "o-1", 1)]

    def broken(batch, number):
        raise RuntimeError("no disk")

    step = streams.logged(broken, "filings", log, lambda n: F.lit(n))
    with pytest.raises(RuntimeError):
        step(spark.range(3), 5)
    streams.logged(lambda batch, number: None, "filings", log, lambda n: F.lit(n))(spark.range(3), 6)
    assert sorted((r["status"], r["detail"]) for r in spark.read.parquet(log).collect()) == [("failed", "batch 5; no disk"), ("ok", "batch 6; rows 3")]


def test_latest_quote_table_is_keyed_and_replayable(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    path = str(tmp_path / "latest")
    quote_file(folder, "1.json", "2026-09-04T10:00:00", {"symbol": "AAPL", "last": "1"})
    quote_file(folder, "2.json", "2026-09-04T11:00:00", {"symbol": "AAPL", "last": "2"}, {"symbol": "MSFT", "last": "7"})
    for attempt in ("a", "b"):
        streams.upsert_quotes(arrived(spark, folder), path, str(tmp_path / attempt)).awaitTermination()
        assert sorted((r["symbol"], r["price"]) for r in Table(spark, path).read().collect()) == [("AAPL", 2.0), ("MSFT", 7.0)]
