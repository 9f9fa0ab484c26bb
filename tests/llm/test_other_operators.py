"""Url rules, exact top-k, page extraction, and the pipeline, against brute force and with their odd cases."""

from __future__ import annotations

import itertools
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import html_template, queries, topk, url_filters

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def _importable(spark):
    queries.importable(spark)


# 1, urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/e", "allow"), ("a.b.org", "/x/y/z", "block")]


def judged(url, rules=RULES):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, "allow")


def test_urls_against_brute_force(spark):
    hosts = ["com", "example.com", "WWW.Example.com", "xexample.com", "a..example.com", "net", "m.net", "c.a.b.org", "a.b.org.", "", "user@h.net:80", "É.net"]
    paths = ["", "/", "/en/", "/en", "/en/a/b/c", "/es/", "/ES/", "/e", "/x/y/zz?q=/en/", "/x/y/z", "?a://b", "#f", "//en/"]
    urls = [f"http://{h}{p}" for h, p in itertools.product(hosts, paths)] + [None, "", "no scheme/en/", "://net/es/", "http://a.net/" + "s/" * 3000, "x\n://net/es/a\nb"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(3, urls[3], "clash"), (3, urls[3], "clash"), (3, urls[4], "clash"), (None, urls[7], "clash")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, verdict string")
    got = sorted(map(repr, (tuple(r) for r in url_filters.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect())))
    assert got == sorted(repr((i, u, *judged(u))) for i, u, _ in rows)


def test_urls_plan_has_no_python_and_empty_tables_work(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    df = url_filters.judge(pages, rules)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|CartesianProduct|NestedLoop", plan)
    assert url_filters.judge(pages.limit(0), rules).count() == 0
    odd = spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("com", None, "block"), ("com", "/", None)], "host string, path string, verdict string")
    assert url_filters.judge(pages, odd).first()["rule"] == "com/"
    assert url_filters.judge(pages, odd.limit(0)).first()["verdict"] == "allow"


# 5, top-k


def brute_top(rows, k, scale=64):
    good = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out = set()
    for i, q in good:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)}
    return out


def test_top_k_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 340)]
    rows += [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (None, [9.0] * 8), (420, [1.0, 2.0, 3.0]), (421, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id bigint, embedding array<float>, rank int")
    for name, value in (("QUERIES", 7), ("CANDIDATES", 64), ("SHARE", 2)):
        monkeypatch.setattr(topk, name, value)
    exact = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    for k in (20, 500):
        got = {tuple(r) for r in topk.search(df, F.col("_id") % 20 == 0, k).collect()}
        assert got == brute_top(exact, k)
    assert topk.search(df.limit(0), F.lit(True)).count() == 0


def test_repeated_vectors_count_and_queries_answer_once(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 0.0])]
    got = [tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("_id") % 20 == 0, 3).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 2048), (20, 2, 1, 2048), (20, 3, 2, 1024)]


def test_huge_components_are_scored_in_whole_numbers(spark):
    rows = [(20, [1e30, 1.0]), (1, [1e-30, 1.0]), (2, [1e30, 0.0]), (3, [-1e30, 0.0])]
    got = [tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("_id") % 20 == 0, 3).orderBy("rank").collect()]
    assert got == [(20, 1, 2, topk.MOST), (20, 2, 1, 4096), (20, 3, 3, topk.LEAST)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_elimination_is_exact(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(size=(400, 6)) * rng.choice([1, 8, 64]))
    q, ids = x[7], rng.permutation(400)
    pivots = topk.choose_pivots(x[:50])
    own = np.arange(400) == 7
    far = topk.distances(x, pivots)
    scores, found, seen = topk.best(q, far[7], x, far, (x * x).sum(1), own, ids, 10)
    expected = sorted((-float(x[i] @ q), ids[i]) for i in range(400) if i != 7)[:10]
    assert [(-s, i) for s, i in zip(scores, found, strict=True)] == expected
    assert seen <= 399


# 7, pages

ARTICLE = "<article><h1>T &amp; U</h1><p>One <b>two</b>&nbsp; three</p><p>a<br>b</p></article>"


def text_of(spark, *pages):
    df = spark.createDataFrame([(i, u, h, "old") for i, (u, h) in enumerate(pages)], "page_id bigint, url string, html string, text string")
    return [r["text"] for r in html_template.main_text(df).orderBy("page_id").collect()]


def test_main_text_of_single_pages(spark):
    pages = [
        ("http://a.org/1", f"<head><title>x</title></head><body><header>h</header><nav>n</nav>{ARTICLE}<aside>s</aside><footer>f</footer></body>"),
        ("http://b.org/1", "<div class='site-header'>no</div><div class=content><p>Main\n text<p>more</div><div id='userComments'><p>c</p></div><form>f</form><script>if (a<b) '</p>'</script>"),
        ("http://c.org/1", None), (None, ""), ("odd", "plain &lt;text&gt; &#233;"), ("http://d.org/1", "<p>open <div class=\"cookie-notice\">k</div>rest<!-- <p>gone</p> --><ul><li>x<li>y</ul>"),
        ("http://e.org/1", "<article><header><h1>Kept</h1></header><p>p</p><div class='share'>s</div><button>b</button></article><p>outside</p>"),
        ("http://f.org/1", "<a href='x'" * 2000 + "<p>" + "long " * 50_000),
    ]
    got = text_of(spark, *pages)
    assert got[0] == "T & U\n\nOne two three\n\na b"
    assert got[1] == "Main text\n\nmore"
    assert got[2] == got[3] == ""
    assert got[4] == "plain <text> é"
    assert got[5] == "open\n\nrest\n\nx\n\ny"
    assert got[6] == "Kept\n\np"
    assert got[7].endswith("long")
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_template.main_text(df).count() == 0


def test_templates_take_constant_text_and_menus_out(spark):
    page = lambda i: ("http://t.org/%d" % i, f"<div><p>Welcome to our site</p><ul><li><a href=/a{i}>go {i}</a></ul></div><div class=body><p>story {i} is new</p><p>and ends {i * 7}</p></div>")
    got = text_of(spark, *(page(i) for i in range(12)), ("http://u.org/", page(3)[1]))
    assert got[:12] == [f"story {i} is new\n\nand ends {i * 7}" for i in range(12)]
    assert got[12] == "Welcome to our site\n\ngo 3\n\nstory 3 is new\n\nand ends 21"  # a host of one page has no template
    df = spark.createDataFrame([(i, *page(i)) for i in range(12)], "page_id bigint, url string, html string").withColumn("host", F.lit("t.org"))
    template = html_template.templates(df).first()
    assert template["constant"] and template["menus"] == ["/div/ul/li"]
    assert any(c["under"] for c in template["classes"])


def test_copies_of_a_page_are_no_template(spark):
    story = "".join(f"<p>paragraph {k} of the mirrored article</p>" for k in range(5))
    copies = [(f"http://m.org/a?utm={i}", f"<body><nav>visit {i}</nav><article>{story}</article><p>Imprint of the host</p></body>") for i in range(6)]
    others = [(f"http://m.org/{i}", f"<body><article><p>other {i}</p></article><p>Imprint of the host</p></body>") for i in range(4)]
    for pages in ([*copies, *others], [(u.replace("http://m.org/", "m.org "), h) for u, h in [*copies, *others]]):
        got = text_of(spark, *pages)
        assert got[:6] == ["\n\n".join(f"paragraph {k} of the mirrored article" for k in range(5))] * 6
        assert got[6:] == [f"other {i}" for i in range(4)]


def test_lists_of_an_article_beside_a_menu(spark):
    menu = "<ul>" + "".join(f"<li><a href=/{k}>a rather long menu entry {k}</a></li>" for k in range(6)) + "<li>You are here: {}</li></ul>"
    pages = [(f"http://l.org/{i}", f"<div>{menu.format(i)}<p>story {i}</p><ul><li>point {i}</li><li>see <a href=/x>x{i}</a> in note {i}</li></ul></div>") for i in range(8)]
    assert text_of(spark, *pages) == [f"story {i}\n\npoint {i}\n\nsee x{i} in note {i}" for i in range(8)]


# queries and the pipeline


def test_queries_with_sql_agree_with_it(spark):
    db = duckdb.connect()
    for name in ("pages", "embeddings", "documents", "conversations"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert set(queries.CHECKS) == {"op1_url_rules", "op5_top_products", "op11_line_dedup", "op12_repair", "op13_trie"}
    for name, sql in queries.CHECKS.items():
        df, result = queries.QUERIES[name](spark, SF), db.sql(sql)
        columns = sorted(df.columns)
        assert sorted(result.columns) == columns
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, (tuple(r) for r in result.select(*columns).fetchall())))


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages_against_their_operators(spark):
    from test_text_operators import brute_components, brute_repeats

    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 8))))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, bench = prose(60), prose(50)
    rows = [(i, prose(int(rng.integers(20, 90))), "en", "s", 0) for i in range(40)]
    rows += [(40, rows[0][1], "en", "s", 0), (41, rows[1][1] + " " + word(), None, None, None)]
    rows += [(i, prose(30) + " " + shared + " " + prose(30), "en", "s", 0) for i in range(42, 46)]
    rows += [(46, prose(40) + " " + bench + " " + prose(9), "en", "s", 0), (47, None, None, None, None), (48, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    near = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert near == set(brute_components([(r[0], r[1]) for r in rows]).values())
    cut = {r["doc_id"]: r for r in corpus_pipeline.repeats(spark, docs, SF).collect()}
    expected = brute_repeats([(r[0], r[1]) for r in rows], 100)
    for i, text, *_ in rows:
        kept = expected[i, (text or "").encode()][0].decode()
        assert (cut[i]["text"] or "") == kept and (text is None or cut[i]["n_chars"] == len(kept))
    tokens = {r["doc_id"]: r for r in corpus_pipeline.tokens(spark, docs, SF).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(tokens[i]["ids"] == model.encode(t or "", add_bos=True, add_eos=True) and tokens[i]["text"] == (t or "") for i, t, *_ in rows)


def test_pipeline_runs_and_keeps_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    result = corpus_pipeline.run(spark, SF)
    assert result.columns == [*docs.columns, "ids"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert 0 < result.count() < docs.count()
    assert result.join(labels.where("toxic = 0 and quality = 1"), "doc_id").count() > 0
    benchmark = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [1 for r in result.collect() for b in benchmark if b in r["text"]]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "leaks", "tokens"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
