"""Pipeline stages judge rows one by one and carry columns of any name: repeated and null ids, clashing names."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import near_dedup, rows

SF = "/root/testdata/sf0.001"
NAMES = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, score int, sentences int, `key` int, `row` int, `_kept` int, id int, component_id int, `start` int, item_id int, shorter int, doc int, `a.b` int"


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9))))
    prose = lambda n: " ".join(word() for _ in range(n))
    leak = max((r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r["text"]), key=len)
    one, two, three, four = (prose(60) for _ in range(4))
    held = [
        (1, one), (1, two), (1, one), (None, one + " end"), (None, three), (2, three + " end"), (2, leak), (2, four), (None, prose(40) + " " + leak),
        (None, ""), (None, ""), (3, None), (3, None), (4, "to be"), (5, "TO  be"), (6, "word " * 40_000),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "kept", 7, 8, *range(1, 11)) for i, t in held], NAMES)
    return docs, held, {"one": one, "two": two, "three": three, "four": four, "leak": leak}


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def carried(df, docs):
    assert df.columns[: len(docs.columns)] == docs.columns
    assert {tuple(r[c] for c in docs.columns[5:]) for r in df.select([rows.quoted(c) for c in docs.columns]).collect()} <= {("kept", 7, 8, *range(1, 11))}


def test_keys_are_unique_and_follow_the_ids(spark, odd):
    docs, held, _ = odd
    got = rows.keyed(docs).select("key", "row.doc_id").orderBy("key").collect()
    assert len({r["key"] for r in got}) == len(held)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted((i for i, _ in held if i is not None)) + [None] * sum(i is None for i, _ in held)
    plain = docs.where("doc_id > 3")
    assert {(r["key"], r["doc_id"]) for r in rows.keyed(plain).select("key", "row.doc_id").collect()} == {(4, 4), (5, 5), (6, 6)}


def test_near_duplicates_by_row(spark, odd):
    docs, _, t = odd
    left = corpus_pipeline.near_duplicates(spark, docs, SF)
    carried(left, docs)
    got = pairs(left)
    assert got[1, t["one"]] == 1 and got[1, t["two"]] == 1  # a repeated id with two texts keeps both, an exact repeat goes
    assert got[None, t["one"] + " end"] == 0 and got[None, t["three"]] == 0 and got[2, t["three"] + " end"] == 1  # null ids come last
    assert got[2, t["four"]] == 1 and got[None, ""] == 2 and got[3, None] == 2  # rows without words stand alone
    assert got[4, "to be"] == 1 and got[5, "TO  be"] == 0


def test_leaks_by_row(spark, odd):
    docs, held, t = odd
    left = corpus_pipeline.leaks(spark, docs, SF)
    carried(left, docs)
    assert pairs(left) == Counter((i, x) for i, x in held if t["leak"] not in (x or ""))


def test_toxicity_and_repeats_carry_every_column(spark, odd):
    docs, held, t = odd
    left = corpus_pipeline.toxic(spark, docs, SF)
    carried(left, docs)
    assert pairs(left) == Counter(held)
    cut = corpus_pipeline.repeats(spark, docs, SF)
    carried(cut, docs)
    got = pairs(cut)
    assert sum(got.values()) == len(held) and got[1, t["two"]] == 1 and got[3, None] == 2


def test_tokens_take_a_free_name(spark, odd):
    docs, held, _ = odd
    done = corpus_pipeline.tokens(spark, docs, SF)
    carried(done, docs)
    assert done.columns[-1] == "ids_2" and done.schema["ids_2"].dataType.simpleString() == "array<int>"
    assert sum(pairs(done).values()) == len(held)
    assert rows.free_name("ids", ["x"]) == "ids" and rows.free_name("ids", ["IDS", "ids_2"]) == "ids_3"


def test_representatives_of_one_repeated_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(9, f"{text} {i % 3}") for i in range(300)], "doc_id bigint, text string")
    left = near_dedup.representatives(docs).collect()
    assert len(left) == 1 and left[0]["doc_id"] == 9
