"""Conversation structure repair: the cheapest edits that make the roles of a conversation read `(s?(ua)+)?`.

A conversation is its rows by turn (nulls first; equal turns by role, then by a digest of the row). Each row has at most one
fault: blank, duplicate of an earlier row (role and text), or truncated. Edits and costs: Keep 0, Rerole to user or assistant 1,
Delete 2 (blank and duplicate rows must go), Insert an empty turn of user or assistant 5; a truncated row that stays costs 5 more.

The lattice has a node per number of rows done and state of the role pattern (start, after s, after u, after a) and an arc per
edit. An auction finds the shortest path: the path from the source is extended along an arc whose cost equals the fall in
price, else the price of its last node is raised to the least of arc cost plus next price and the path is contracted. Prices
stay integers and never exceed an arc's cost plus the next price. The rows are solved in short stretches from the last to the
first: what lies behind a stretch has exact prices, which is where its paths end, so the work grows with the rows. At the end
every arc of every cheapest path is tight (cost equal to the fall in price); walking sets of nodes along the tight arcs that
reach the end, letter by letter, gives the audit that comes first in ASCII.

On Spark: faults are native expressions and aggregates on digests; the rows get their places in one order over all rows, in
ranges, so a long conversation is spread over many tasks; one letter per row is gathered in pieces of 4,096 rows, and only
these letters of a conversation (the size of its audit, which is one cell of the result) meet in a task. Texts are never
grouped: the edits go back to the rows by place.

Nulls: a null id is a conversation of its own; null roles and texts count as one space. Rows that agree in all of id, turn,
role and text are one row and its duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.hashing import joined_sha256
from plumbline.llm.line_dedup import SPACES, digest
from plumbline.llm.store import land
from plumbline.operators.matching import global_rank

COLUMNS = ("conv_id", "turn", "role", "text")
PIECE = 4096
STRETCH = 16

# A row's letter: four initials (s, u, a, other) times four faults (none, truncated, blank, duplicate).
LETTERS = "ABCDEFGHIJKLMNOP"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_FOLLOWS = {START: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
_WANTED = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5


def _arcs(letter: str | None) -> list[list[tuple[int, str, int]]]:
    """For each state the arcs (cost, edit, distance to the next node); four nodes per row. Without a letter: after the last row."""
    initial, fault = divmod(LETTERS.index(letter), 4) if letter else (None, None)
    out = []
    for state in range(4):
        arcs = [(INSERT, "I", _WANTED[state] - state)]
        if letter is None:
            if state in (START, AFTER_A):
                arcs.append((0, "", 4 - state))
        else:
            arcs.append((DELETE, "D", 4))
            if fault < 2:
                more = TRUNCATED * fault
                if (to := _FOLLOWS[state].get("sua-"[initial])) is not None:
                    arcs.append((KEEP + more, "K", 4 + to - state))
                arcs.append((REROLE + more, "R", 4 + _WANTED[state] - state))
        out.append(arcs)
    return out


ARCS = {letter: _arcs(letter) for letter in [*LETTERS, None]}
LEAST = {letter: min(cost for arcs in ARCS[letter] for cost, edit, _ in arcs if edit != "I") for letter in ARCS}


def auction(rows: list[list], prices: list[int], source: int, stop: int) -> None:
    """Raise prices until those of the source is exact; nodes from `stop` on have exact prices."""
    path = [source]
    while (node := path[-1]) < stop:
        least, to = min((cost + prices[node + step], node + step) for cost, _, step in rows[node >> 2][node & 3])
        if prices[node] < least:
            prices[node] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def repair(letters: str) -> tuple[int, str]:
    """Least cost and audit of one conversation, given a letter per row."""
    n = len(letters)
    rows = [ARCS[c] for c in letters] + [ARCS[None]]
    end = 4 * n + 4
    prices = [0] * (end + 1)
    stop = end
    for first in [n, *range((n - 1) // STRETCH * STRETCH, -1, -STRETCH)]:
        low = min(prices[stop : stop + 4])
        for k in range(stop // 4 - 1, first - 1, -1):
            low += LEAST[letters[k] if k < n else None]
            prices[4 * k : 4 * k + 4] = [low] * 4
        for state in range(4):
            auction(rows, prices, 4 * first + state, stop)
        stop = 4 * first

    def tight(node: int) -> Iterator[tuple[str, int]]:
        return ((edit, node + step) for cost, edit, step in rows[node >> 2][node & 3] if prices[node] == cost + prices[node + step])

    reaches = bytearray(end + 1)
    reaches[end] = 1
    for k in range(n, -1, -1):
        for _ in range(3):  # inserts stay at a row: at most two follow each other
            for node in range(4 * k, 4 * k + 4):
                reaches[node] = reaches[node] or any(reaches[to] for _, to in tight(node))

    audit, nodes = [], {START}
    while True:
        found: dict[str, set[int]] = {}
        for node in nodes:
            for edit, to in tight(node):
                if reaches[to]:
                    found.setdefault(edit, set()).add(to)
        edit = min(found)
        if not edit:
            return prices[START], "".join(audit)
        audit.append(edit)
        nodes = found[edit]


@lru_cache(100_000)
def _short(letters: str) -> tuple[int, str]:
    return repair(letters)


_LEGAL = {(0, 1), (1, 2), (2, 1)}
_ILLEGAL = np.array([[(i, j) not in _LEGAL for j in range(4)] for i in range(4)])
NUMBERS = ("blank", "duplicate", "truncated", "illegal", "cost")
_SOLVED = ", ".join(f"{n} bigint" for n in NUMBERS) + ", audit string, pieces array<struct<place:bigint,audit:string,out:bigint,headed:boolean>>"
_PIECE = pa.struct([("place", pa.int64()), ("audit", pa.string()), ("out", pa.int64()), ("headed", pa.bool_())])
_TYPES = [*((n, pa.int64()) for n in NUMBERS), ("audit", pa.string()), ("pieces", pa.list_(_PIECE))]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {name: [] for name, _ in _TYPES}
        for pieces in batch.column("pieces"):
            pieces = pieces.as_py()
            letters = "".join(p["letters"] for p in pieces)
            cost, audit = _short(letters) if len(letters) <= 64 else repair(letters)
            codes = np.frombuffer(letters.encode(), np.uint8) - 65
            faults, initials = np.bincount(codes % 4, minlength=4), codes // 4
            edits = np.frombuffer(audit.encode(), np.uint8)
            moved, stays = np.flatnonzero(edits != ord("I")), np.cumsum(edits != ord("D"))
            headed = bool(len(stays) and stays[-1] % 2)
            ends = np.cumsum([len(p["letters"]) for p in pieces])
            cuts = [0, *(moved[ends[:-1] - 1] + 1), len(audit)]  # a piece's edits begin after the last row of the piece before
            for name, value in zip(out, (
                int(faults[2]), int(faults[3]), int(faults[1]), int(_ILLEGAL[initials[:-1], initials[1:]].sum()), cost, audit,
                [{"place": p["place"], "audit": audit[a:b], "out": int(stays[a - 1]) if a else 0, "headed": headed} for p, a, b in zip(pieces, cuts[:-1], cuts[1:], strict=True)],
            ), strict=True):
                out[name].append(value)
        columns = [batch.column("conv"), *(pa.array(out[name], kind) for name, kind in _TYPES)]
        yield pa.RecordBatch.from_arrays(columns, ["conv", *out])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per edit that leaves a turn: place of the row (null for an insert), place in the result, role (null: its own)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            pieces = batch.column("piece").to_pylist()
            edits = np.frombuffer("".join(p["audit"] for p in pieces).encode(), np.uint8)
            row = np.repeat(np.arange(len(pieces)), [len(p["audit"]) for p in pieces])
            first = np.searchsorted(row, np.arange(len(pieces)))
            inserted, left = edits == ord("I"), edits != ord("D")
            rows, outs = (np.concatenate([[0], np.cumsum(x)]) for x in (~inserted, left))

            def counted(sums: np.ndarray, start: str) -> np.ndarray:
                return (np.array([p[start] for p in pieces], np.int64) - sums[first])[row] + sums[1:] - 1

            places, out = counted(rows, "place"), counted(outs, "out")
            odd = (out + np.array([p["headed"] for p in pieces], np.int64)[row]) % 2 == 1
            roles = pa.array(np.where(odd, "assistant", "user")[left], mask=(edits == ord("K"))[left]).cast(pa.string())
            columns = [batch.column("conv").take(pa.array(row[left])), pa.array(places[left], mask=inserted[left]), pa.array(out[left]), roles]
            yield pa.RecordBatch.from_arrays(columns, ["conv", "place", "out", "new_role"])


def damage(conversations: DataFrame) -> DataFrame:
    """Rows as the contract damages them, with `copies`; a dropped row has none."""
    conv, turn, role, text = (F.col(c) for c in COLUMNS)
    space = F.lit(" ")
    key = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    role, text, fault = F.coalesce(role, space), F.coalesce(text, space), F.crc32(key) % 20
    return conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


class Repaired:
    """`report`: one row per conversation, `turns`: the repaired turns."""

    def __init__(self, report: DataFrame, turns: DataFrame):
        self.report, self.turns = report, turns


def repaired(rows: DataFrame) -> Repaired:
    """Repair the conversations of `rows` (conv_id, turn, role, text, and optionally `copies`, how often each row counts; 0: it is
    gone, but its conversation is still reported). Other columns are left out.

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. turns: conv_id, out (from 0), role, text. A
    conversation without rows has zeros, an empty audit and no turns; an empty table has neither.
    """
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    rows = rows.select(
        F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.alias("copies"),
    )
    turn = F.when(F.col("copies") > 0, F.col("turn"))
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long")
    base = rows.groupBy("conv").agg(gaps.alias("gaps"))

    k1, k2 = digest(F.col("conv").isNull(), F.col("conv"), F.col("turn").isNull(), F.col("turn"), F.col("role"), F.col("text"))
    m1, m2 = digest(F.col("conv").isNull(), F.col("conv"), F.col("role"), F.col("text"))
    keyed = rows.where("copies > 0").withColumns({"k1": k1, "k2": k2})
    ending = F.rtrim("text", F.lit(SPACES))
    initial = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1).when(F.startswith("role", F.lit("a")), 2).otherwise(3)
    fault = F.when(ending == "", 2).when(F.substring(ending, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    light = keyed.select("*", m1.alias("m1"), m2.alias("m2"), initial.alias("initial"), fault.alias("fault")).groupBy("k1", "k2").agg(
        F.sum("copies").alias("copies"), *(F.first(c).alias(c) for c in ("conv", "turn", "role", "m1", "m2", "initial", "fault")),
    )
    light = land(light, "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = light.groupBy("m1", "m2").agg(F.min(when).alias("first"))
    each = light.join(first, ["m1", "m2"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    again = (F.col("copy") > 1) | ~F.col("turn").eqNullSafe(F.col("first.turn"))
    code = 4 * F.col("initial") + F.when((F.col("fault") != 2) & again, 3).otherwise(F.col("fault"))
    each = each.select("conv", "turn", "role", "k1", "k2", "copy", F.substring(F.lit(LETTERS), code + 1, F.lit(1)).alias("letter"))
    placed = global_rank(each, ["conv", "turn", "role", "k1", "k2", "copy"], "place")

    pieces = placed.groupBy("conv", F.floor(F.col("place") / PIECE).alias("piece")).agg(
        F.min("place").alias("place"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda x: x["letter"]), "").alias("letters"),
    )
    gathered = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", "letters"))).alias("pieces"))
    conv = f"conv {rows.schema['conv'].dataType.simpleString()}"
    solved = land(gathered.mapInArrow(_solve, f"{conv}, {_SOLVED}"), "solved")

    edits = solved.select("conv", F.explode("pieces").alias("piece"))
    edits = land(edits.mapInArrow(_spread, f"{conv}, place bigint, out bigint, new_role string"), "edits")
    kept = edits.where("place is not null").join(placed.select("place", "k1", "k2"), "place")
    texts = keyed.groupBy("k1", "k2").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    kept = kept.join(texts, ["k1", "k2"]).select("conv", "out", F.coalesce("new_role", "role").alias("role"), "text")
    inserted = edits.where("place is null").select("conv", "out", F.col("new_role").alias("role"), F.lit("").alias("text"))
    turns = kept.unionByName(inserted).withColumnRenamed("conv", "conv_id")

    found = solved.select(F.col("conv").alias("_conv"), *NUMBERS, "audit")
    report = base.join(found, F.col("conv").eqNullSafe(F.col("_conv")), "left").select(
        F.col("conv").alias("conv_id"), "gaps", *(F.coalesce(c, F.lit(0)).alias(c) for c in NUMBERS), F.coalesce("audit", F.lit("")).alias("audit"),
    )
    return Repaired(report, turns)


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's `role:text`, newline-joined."""
    lines = turns.withColumn("line", F.concat("role", F.lit(":"), "text"))
    return joined_sha256(lines, "conv_id", "out", "line", "\n", "repaired_sha256")
