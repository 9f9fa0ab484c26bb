"""Reconciliation by digests, the gram index of the directory, the file index of the archive, status rows of symbols."""

from __future__ import annotations

import json
import os
import random
from datetime import date, timedelta

import pytest

from plumbline.operators import audit, catalog_index, directory, fundamentals, reconcile
from plumbline.session import input_tasks
from plumbline.sources import file_index, readers

SAMPLES = "symbol string, date date, price double, pe double, eps double, eps_filed_at date, eps_period_end date"


def samples(spark, change=lambda symbol, day, row: row):
    rows = []
    for symbol in "KLMN":
        for step in range(0, 700, 5):
            day = date(2021, 1, 4) + timedelta(days=step)
            row = change(symbol, day, (symbol, day, 40.0 + step % 7, 10.0 + step % 7, 4.0, date(2020, 11, 2), date(2020, 9, 30)))
            if row:
                rows.append(row)
    return spark.createDataFrame(rows, SAMPLES)


def harmed(symbol, day, row):
    if symbol == "L" and day.month == 5:
        return (*row[:2], row[2] + 1, *row[3:])
    if symbol == "M" and day == date(2021, 1, 9):
        return None
    return (*row[:3], row[3] * (1 + 1e-14), *row[4:]) if symbol == "N" and day.month == 7 else row


def issues(df):
    return sorted((r["symbol"] or "", str(r["date"]), r["issue"]) for r in df.collect())


def test_digests_find_what_the_full_comparison_finds(spark):
    published, rebuilt = samples(spark, harmed), samples(spark)
    found = issues(reconcile.reconcile_by_digests(published, rebuilt))
    assert found == issues(audit.reconcile_samples(published, rebuilt)) and len(found) > 5
    assert {f[2] for f in found} == {"price", "not_published"}
    assert issues(reconcile.reconcile_by_digests(published.limit(0), rebuilt)) == issues(audit.reconcile_samples(published.limit(0), rebuilt))
    assert issues(reconcile.reconcile_by_digests(rebuilt, rebuilt)) == []


def test_descent_stops_where_digests_agree(spark):
    left, right = reconcile.digest_tree(samples(spark, harmed)), reconcile.digest_tree(samples(spark))
    nodes = [(r["level"], r["symbol"], r["year"], r["month"], r["differs"]) for r in reconcile.compared_nodes(left, right).collect()]
    assert {n[1] for n in nodes if n[0] == "year"} == {"L", "M", "N"}  # K agrees and is not opened
    assert {n[2] for n in nodes if n[0] == "month" and n[1] == "M"} == {2021}
    months = {n[1:4] for n in nodes if n[0] == "month" and n[4]}
    assert months == {("L", 2021, 5), ("L", 2022, 5), ("M", 2021, 1), ("N", 2021, 7), ("N", 2022, 7)}


def test_only_rows_of_differing_months_move(spark):
    published, rebuilt = samples(spark, harmed), samples(spark)
    months = reconcile.differing_months(reconcile.digest_tree(published), reconcile.digest_tree(rebuilt))
    kept = reconcile.suspects(published, months)
    assert {(r["symbol"], r["date"].month) for r in kept.collect()} == {("L", 5), ("M", 1), ("N", 7)}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_digests_tell_nulls_by_place_and_count_repeats(spark):
    rows = [("K", date(2021, 3, 1), None, 2.0, 1.0, None, None), ("K", date(2021, 3, 1), 2.0, None, 1.0, None, None)]

    def root(chosen):
        tree = reconcile.digest_tree(spark.createDataFrame(chosen, SAMPLES))
        return tuple(tree.where("level = 'symbol'").select("n", "h1", "h2").first())

    assert root(rows[:1]) != root(rows[1:]) and root(rows) == root(rows[::-1]) and root(rows[:1] * 2) != root(rows[:1] * 4)


def test_rows_without_symbol_or_date_are_always_compared(spark):
    odd = spark.createDataFrame([(None, date(2021, 3, 1), 1.0, 2.0, 1.0, None, None), ("K", None, 1.0, 2.0, 1.0, None, None)], SAMPLES)
    both = samples(spark).unionByName(odd)
    assert issues(reconcile.reconcile_by_digests(both, both)) == issues(audit.reconcile_samples(both, both))


CATALOG = [("AMZN", "Amazon Com Inc"), ("RIV", "River Wood Group"), ("WOOD", "Wood And River"), ("X", "Xylo"), (None, "Riverless"), ("ÄÖ", "Ärger Öl"), ("E", None)]


def search_pairs(df):
    return sorted((r["needle"], r["symbol"] or "", r["name"] or "", r["rank"], r["position"]) for r in df.collect())


def test_index_equals_the_scan(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 5))) for _ in range(60)]
    rows = CATALOG + [(f"S{i}{rng.choice(words).upper()}", " ".join(rng.choices(words, k=3)).title()) for i in range(300)]
    catalog = spark.createDataFrame(rows, "symbol string, name string")
    texts = [" AWS ", "riv", "RIVER W", "x", "o", "öl", "ä", "zz", "e", "no such text", "s1"]
    texts += ["".join(rng.choices("abcdes 123", k=rng.randint(1, 5))).strip() or "a" for _ in range(1000)]
    catalog_index.write_index(catalog, str(tmp_path / "grams"))
    asked = spark.createDataFrame([(t,) for t in [*texts, "", "  ", None]], "text string")
    found = search_pairs(catalog_index.search_indexed(catalog, str(tmp_path / "grams"), asked))
    expected = []
    for needle in sorted({directory.NICKNAMES.get(t.strip().lower(), t.strip().lower()) for t in texts}):
        hits = []
        for symbol, name in rows:
            s, n = (symbol or "").lower(), (name or "").lower()
            if needle in s or needle in n:
                rank = 0 if s == needle else 1 if n == needle else 2 if s.startswith(needle) else 3 if n.startswith(needle) else 4
                hits.append((rank, -1 if name is None else len(name), symbol or "", name or ""))
        expected += [(needle, s, n, rank, place) for place, (rank, _, s, n) in enumerate(sorted(hits)[:8], 1)]
    assert [f for f in found] == sorted(expected)


def test_rarest_gram_is_looked_up(spark, tmp_path):
    rows = [(f"T{i}", "Common Holding") for i in range(200)] + [("Q", "Quartz Holding")]
    catalog_index.write_index(spark.createDataFrame(rows, "symbol string, name string"), str(tmp_path))
    wanted = spark.createDataFrame([("quartz holding",), ("nowhere",)], "needle string")
    rare = catalog_index.rarest_grams(spark, str(tmp_path), wanted).collect()
    assert [(r["needle"], r["entries"]) for r in rare] == [("quartz holding", 1)]
    assert [r["symbol"] for r in catalog_index.candidates(spark, str(tmp_path), wanted).collect()] == ["Q"]


def shard(path, symbol, *days, cik=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    document = {"accessionNumber": [f"{symbol}-{d}" for d in days], "form": ["10-Q"] * len(days), "filingDate": list(days),
                "reportDate": list(days), "primaryDocument": ["a.htm"] * len(days), "items": [""] * len(days)}
    document.update({"symbol": symbol} if cik is None else {"cik": cik})
    path.write_text(json.dumps(document) + "\n")


@pytest.fixture
def archive(tmp_path):
    (tmp_path / "recent").mkdir()
    recent = [{"cik": "71", "tickers": [s], "filings": {"recent": {k: [] for k in ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument", "items")}}} for s in ["OAK"]]
    (tmp_path / "recent" / "a.json").write_text("\n".join(json.dumps(r) for r in recent) + "\n")
    for n, symbol in enumerate(["ASH", "ELM", "FIR", "YEW"]):
        shard(tmp_path / "archive" / "filing_to=2019-12-31" / f"{n}.json", symbol, "2019-02-01", "2019-05-01")
    shard(tmp_path / "archive" / "filing_to=2018-12-31" / "CIK0000000071-1.json", "none", "2018-06-01", cik="71")
    return tmp_path


def names(files):
    return sorted(os.path.basename(r["path"]) for r in files.collect())


def test_archive_reads_open_only_files_of_the_symbols(spark, archive):
    folder, index, recent = str(archive / "archive"), str(archive / "index"), str(archive / "recent")
    payloads = readers.filing_payloads(spark, recent)
    assert file_index.update_index(spark, folder, index, payloads) == 5
    assert file_index.update_index(spark, folder, index, payloads) == 0
    wanted = spark.createDataFrame([("ELM",), ("OAK",), (None,)], "symbol string")
    assert names(file_index.files_of(spark, folder, index, wanted)) == ["1.json", "CIK0000000071-1.json"]
    rows = file_index.read_archive_of(spark, recent, folder, index, wanted, "2018-01-01").collect()
    assert sorted((r["symbol"], str(r["filed"])) for r in rows) == [("ELM", "2019-02-01"), ("ELM", "2019-05-01"), ("OAK", "2018-06-01")]
    assert len(file_index.read_archive_of(spark, recent, folder, index, wanted, "2019-01-01").collect()) == 2
    nobody = spark.createDataFrame([("PINE",)], "symbol string")
    assert file_index.read_archive_of(spark, recent, folder, index, nobody, "2018-01-01").collect() == []


def test_new_and_changed_files_are_opened_until_indexed(spark, archive):
    folder, index, recent = str(archive / "archive"), str(archive / "index"), str(archive / "recent")
    payloads = readers.filing_payloads(spark, recent)
    file_index.update_index(spark, folder, index, payloads)
    shard(archive / "archive" / "filing_to=2019-12-31" / "9.json", "ELM", "2019-09-01")
    shard(archive / "archive" / "filing_to=2019-12-31" / "0.json", "ELM", "2019-10-01", "2019-11-01", "2019-12-01")
    wanted = spark.createDataFrame([("ELM",)], "symbol string")
    assert names(file_index.files_of(spark, folder, index, wanted)) == ["0.json", "1.json", "9.json"]
    assert len(file_index.read_archive_of(spark, recent, folder, index, wanted, "2018-01-01").collect()) == 6
    assert file_index.update_index(spark, folder, index, payloads) == 2
    ash = spark.createDataFrame([("ASH",)], "symbol string")
    assert names(file_index.files_of(spark, folder, index, ash)) == []  # what 0.json held before is stale


def test_symbols_without_revenue_get_a_status_row(spark):
    periods = spark.createDataFrame([("A", "capex", date(2026, 6, 30)), ("B", "revenue", date(2026, 3, 31)), ("D", "revenue", date(2026, 3, 31))], "symbol string, metric string, end date")
    shots = spark.createDataFrame([("B", date(2026, 3, 31), 5.0), ("D", date(2026, 3, 31), None)], "symbol string, period_end date, revenue_ttm double")
    listed = spark.createDataFrame([("A",), ("Z",), ("Z",), (None,)], "symbol string")
    rows = {r["symbol"]: (r["status"], r["metrics"]) for r in fundamentals.snapshot_status(periods, shots, listed).collect()}
    assert rows == {"A": ("no_revenue", "capex"), "B": ("complete", "revenue"), "D": ("partial", "revenue"), "Z": ("no_periods", "")}


def test_an_index_dealt_to_tasks_finds_the_same_and_lists_repeated_entries_once(spark, tmp_path):
    rows = [("AB", "Alpha Beta"), ("AB", "Alpha Beta"), ("AB", "Abacus"), (None, "Alphabet"), ("XY", None)]
    catalog = spark.createDataFrame(rows, "symbol string, name string").coalesce(1)
    texts = spark.createDataFrame([("alpha",), ("ab",), ("xy",)], "text string")
    whole, dealt = str(tmp_path / "whole"), str(tmp_path / "dealt")
    catalog_index.write_index(catalog, whole)
    catalog_index.write_index(catalog, dealt, 5)

    def stored(path):
        return sorted(map(str, spark.read.parquet(f"{path}/postings").select("symbol", "gram", "part").collect()))

    def found(path):
        return sorted(map(str, catalog_index.search_indexed(catalog, path, texts).collect()))

    assert stored(dealt) == stored(whole) and len(stored(dealt)) == len(set(stored(dealt)))
    assert found(dealt) == found(whole) != []


def test_tasks_grow_with_the_files_of_a_folder(spark, tmp_path):
    (tmp_path / "t.parquet").mkdir()
    (tmp_path / "t.parquet" / "part-0").write_bytes(b"x" * 900)
    own = spark.sparkContext.defaultParallelism
    assert input_tasks(spark, str(tmp_path), 1000) == own
    assert input_tasks(spark, str(tmp_path), 10) == 90
