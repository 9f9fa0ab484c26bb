"""Line dedup, conversation repair and the prefix trie, against brute force and with their odd cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import conversation_repair, line_dedup, prefix_trie, queries


@pytest.fixture(scope="module", autouse=True)
def _importable(spark):
    queries.importable(spark)


# 11, lines


def deduplicated(rows, least_length, least_docs):
    """(id, kept, number of lines, places dropped) of each row, by plain dictionaries."""

    def keys(text):
        return [re.sub("[A-Z]", lambda c: c[0].lower(), line.strip(" \t\n\x0b\x0c\r")) for line in (text or "").split("\n")]

    holders = defaultdict(set)
    for i, text in rows:
        for key in keys(text):
            if len(key) >= least_length:
                holders[key].add(i)
    last = {key: max(ids, key=lambda i: (i is not None, i or 0)) for key, ids in holders.items() if len(ids) >= least_docs}
    out = []
    for i, text in rows:
        lines, gone = (text or "").split("\n"), [n for n, key in enumerate(keys(text)) if key in last and last[key] != i]
        out.append((i, "\n".join(line for n, line in enumerate(lines) if n not in gone), len(lines), gone))
    return sorted(out, key=repr)


def lines_found(df, **options):
    return sorted(((r["doc_id"], r["kept"], r["n_lines"], r["dropped"]) for r in line_dedup.without_repeated_lines(df, **options).collect()), key=repr)


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pool = ["", " ", "Ab", "aB ", "\tab\r", "abc", "ABC\x0b", "Éab", "éab", "longer line", "a ", "ab ab", "日本語"]
    rows = [(i, "\n".join(rng.choice(pool, rng.integers(0, 12)))) for i in range(60)]
    rows += [(None, "abc\nAB"), (None, "abc"), (70, None), (70, ""), (71, "abc\nabc\nx\nabc"), (71, "abc\nabc\nx\nabc"), (71, "y\nabc"), (72, "\n\n"), (-5, "ab\nlonger line\n")]
    rows += [(73, "ab\n" * 3000 + "own"), (74, "z" * 200_000 + "\nabc")]
    df = spark.createDataFrame([(i, t, "clash", 9, [1]) for i, t in rows], "doc_id bigint, text string, kept string, n_lines int, dropped array<int>")
    for least_length, least_docs in ((2, 3), (1, 2), (0, 1), (3, 40)):
        assert lines_found(df, least_length=least_length, least_docs=least_docs) == deduplicated(rows, least_length, least_docs)
    assert lines_found(df.limit(0)) == []


def test_lines_plan_is_native_and_texts_move_once(spark):
    df = spark.createDataFrame([(i, "a line that many documents hold\nown") for i in range(5)], "doc_id bigint, text string")
    found = line_dedup.without_repeated_lines(df)
    assert found.where("kept = 'own'").count() == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|CartesianProduct|NestedLoop", plan)


# 12, repair


def edits_of(rows, k):
    """Row k: every (edit, role initial it leaves or none, cost)."""
    initial, fault = divmod(conversation_repair.LETTERS.index(rows[k]), 4)
    yield "D", "", 2
    if fault < 2:
        yield "K", "sua-"[initial], 5 * fault
        yield "R", "u", 1 + 5 * fault
        yield "R", "a", 1 + 5 * fault


def cheapest(rows):
    """Every edit list with up to two inserts before each row and at the end."""
    inserts = [("", ""), ("I", "u"), ("I", "a"), ("II", "ua"), ("II", "au")]
    best = None
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(*(edits_of(rows, k) for k in range(len(rows)))):
            roles = "".join(g[1] + e[1] for g, e in zip(gaps, [*edits, ("", "", 0)]))
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "".join(g[0] + e[0] for g, e in zip(gaps, [*edits, ("", "", 0)]))
                found = (5 * audit.count("I") + sum(e[2] for e in edits), audit)
                best = min(best or found, found)
    return best


def suffixes(rows):
    """The same by the cheapest edits of every suffix, from each state."""
    follows = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, ""), "s": (10, "II"), "u": (5, "I"), "a": (0, "")}
    for k in range(len(rows) - 1, -1, -1):
        plain = {}
        for state in follows:
            plain[state] = min(
                (cost + best[to][0], e + best[to][1]) for e, left, cost in edits_of(rows, k)
                if (to := follows[state].get(left) if left else state) is not None
            )
        one = {q: min(plain[q], (5 + plain[w][0], "I" + plain[w][1])) for q, w in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u"))}
        best = {q: min(one[q], (5 + one[w][0], "I" + one[w][1])) for q, w in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u"))}
    return best[""]


def test_auction_against_all_edit_lists():
    for n in range(3):
        for rows in itertools.product(conversation_repair.LETTERS, repeat=n):
            assert conversation_repair.repair("".join(rows)) == cheapest(rows) == suffixes(rows)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=conversation_repair.LETTERS, max_size=90))
def test_auction_against_suffixes(rows):
    assert conversation_repair.repair(rows) == suffixes(rows)


def test_auction_grows_with_the_rows():
    rng = random.Random(1)
    for alphabet in ("ABC", conversation_repair.LETTERS, "EEEI", "B", "M"):
        rows = "".join(rng.choice(alphabet) for _ in range(6_000))
        assert conversation_repair.repair(rows) == suffixes(rows)


SPACE = " \t\n\x0b\x0c\r"


def repaired_by_hand(rows):
    """conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, digest), rows as the contract damages them."""
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept[conv] += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, turns in kept.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, letters = set(), ""
        for _, role, text in turns:
            ending = text.rstrip(SPACE)
            fault = 2 if not ending else 3 if (role, text) in seen else 0 if ending[-1] in ".!?" else 1
            seen.add((role, text))
            letters += conversation_repair.LETTERS[4 * ("sua".find(role[:1]) if role else -1) % 16 + fault]
        cost, audit = suffixes(letters)
        numbers = [t for t, _, _ in turns if t is not None]
        firsts = [role[:1] for _, role, _ in turns]
        lines, k, headed = [], 0, sum(e != "D" for e in audit) % 2
        for e in audit:
            if e != "D":
                role = turns[k][1] if e == "K" else ("user", "assistant")[(len(lines) + headed) % 2]
                lines.append(f"{role}:{'' if e == 'I' else turns[k][2]}")
            k += e != "I"
        faults = [conversation_repair.LETTERS.index(c) % 4 for c in letters]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count(2), faults.count(3), faults.count(1),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def repair_query(spark, tmp_path, rows):
    path = str(tmp_path / f"c{random.random()}")
    spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id bigint, turn bigint, role string, text string, letter string, copies int").write.parquet(f"{path}/conversations.parquet")
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[c] for c in columns) for r in queries.QUERIES["op12_repair"](spark, path).collect()}


def test_repair_against_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys"], ["Hi.", "Hi", "No!", "Why?\n", " ", "", "\t\x0b", None, "é.", "...", "Hi. "]
    rows = []
    for c in [*range(120), -3, None]:
        for t in range(rng.randrange(1, 9)):
            text = rng.choice(texts)
            rows.append((c, None if t == 0 and rng.random() < 0.1 else 2 * t, rng.choice(roles), text if text is None or rng.random() < 0.4 else f"{t} {text}"))
    rows += [(500, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(700)] + [(501, 3, "user", "x" * 300_000 + "."), (502, 1, "user", "Hi."), (502, 1, "user", "Hi."), (502, 1, "user", "Hi.")]
    monkeypatch.setattr(conversation_repair, "PIECE", 64)
    assert repair_query(spark, tmp_path, rows) == repaired_by_hand(rows)
    assert repair_query(spark, tmp_path, []) == {}
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repair_query(spark, tmp_path, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# 13, trie


def trie_by_hand(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    nodes = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(int(c / 20) * 20, [])[:h] + v[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], ([], []))[0].append(c)
        nodes[path][1].append(c)
    out = {}
    for path, (members, ends) in sorted(nodes.items(), key=lambda x: -len(x[0])):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        below = [v for k, v in out.items() if len(k) == len(path) + 1 and k[:-1] == path]
        out[path] = (
            min(members), len(path), min(nodes[path[:-1]][0]) if path else None, len(members), len(below), sum(v[5] for v in below) or 1,
            (len(members) - 1) * words + sum(v[6] for v in below), hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest(),
        )
    return sorted(out.values(), key=repr)


def trie_query(spark, tmp_path, rows):
    path = str(tmp_path / f"t{random.random()}")
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, turns string").write.parquet(f"{path}/conversations.parquet")
    return sorted((tuple(r) for r in queries.QUERIES["op13_trie"](spark, path).collect()), key=repr)


@pytest.fixture
def many_ranges(spark):
    """Ranges stay as many as there are shuffle partitions, however small."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_trie_against_brute_force(spark, tmp_path, monkeypatch, many_ranges):
    rng = random.Random(9)
    rows = []
    for c in [*range(130), *range(1000, 1040), -7, 2**40]:
        if c % 20 or c < 60:
            same = c % 3 == 0  # a third are copies
            for t in range(5 if same else rng.randrange(1, 7)):
                who = ("user", "assistant")[t % 2]
                rows.append((c, None if t == 0 and c % 4 == 0 else t, who, f"a turn {t}" if same else rng.choice(["a b", "a  b", "", None, "é\x0bz", f"turn {t}"])))
    rows += [(600, t, "user", f"step {t % 3}") for t in range(90)] + [(601, t, "user", f"step {t % 3}") for t in range(80)] + [(602, 1, None, "long " * 40_000)]
    rows += [(603, 1, "user", "twice"), (603, 1, "user", "twice"), (None, 1, "user", "no id"), (None, 2, None, None)]
    rng.shuffle(rows)
    expected = trie_by_hand(rows)
    for width in (2, 32):
        monkeypatch.setattr(prefix_trie, "WIDTH", width)
        assert trie_query(spark, tmp_path, rows) == expected
    assert trie_query(spark, tmp_path, []) == []
    assert trie_query(spark, tmp_path, [(None, 1, "user", "a")]) == []
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)  # its head is absent: no turns are left
    assert trie_query(spark, tmp_path, [(lone, 0, "user", "gone")]) == trie_by_hand([(lone, 0, "user", "gone")])


def test_range_holds_few_edges():
    sizes = np.array([3, 3, 2, 1, 3])
    high = np.array([1, 1, 1, 1, 1, 2, 1, 2, 2, 3, 3, 3])
    levels = prefix_trie._Levels(np.arange(5), sizes, high, high * 0, high * 0 + 1)
    paths = {i: [int(levels.high[i])] for i in range(levels.total)}
    assert len(levels.edges()) == 7 and levels.total == 10 and paths[0] == [0]
    assert levels.count.tolist()[:4] == [5, 3, 1, 1]
