"""Prefix trie of conversations: every distinct sequence of first turns, with what its subtree holds.

A turn's id is 127 bits of a hash of role and text, so a conversation is a sequence of whole numbers. Spark cuts all sequences
into ranges of one order (sequence, then id), which a group of equal conversations of any size cannot fill. Inside a range the
ids form a matrix with one row per conversation, padded with -1 and handled in blocks of `WIDTH` columns, so one long
conversation does not widen it for all. A lexsort puts rows with equal prefixes next to each other, the change masks of the
columns, OR-ed from left to right, mark where nodes start, and reduceat sums every depth over them, and the subtrees from the
deepest level up.

Only nodes on the path of a range's first or last row can go on in another range. They are kept apart, at most two paths per
range, and recombined by a digest of their path: counts are added, own values go up the tree once the counts are known. All
other nodes are complete where they are made.

Null ids take no part. Equal turns are ordered by role, then by a digest of the text. An empty table has no nodes. Two
different turns count as one if 127 bits of their hashes agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.hashing import joined_sha256
from plumbline.llm.line_dedup import digest
from plumbline.llm.store import land

WIDTH = 32
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = bytes(16)
_MASK = (1 << 63) - 1
COMPLETE, EDGE, END = range(3)
_COLUMNS = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_PARTS = f"kind int, key binary, parent_key binary, words bigint, {_COLUMNS}"
_ARROW = pa.schema([
    ("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("words", pa.int64()),
    *((name, pa.int64()) for name in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()),
])


def sequences(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns in order (two halves of the id, words)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ids = [h.bitwiseAND(F.lit(_MASK)).alias(f"h{i}") for i, h in enumerate(digest(role, text), 1)]
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn", role.alias("role"), *ids, words)
    ordered = conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["h1"], t["h2"], t["words"])).alias("turns"))


def rebuilt(conversations: DataFrame, cycle: int = 20, most: int = 4) -> DataFrame:
    """Sequences whose first h turns come from conversation c - c % cycle, h = crc32(c) % most; none where that is absent.
    The remainder has the sign of c, as in SQL."""
    own = land(sequences(conversations), "sequences")
    heads = own.where(F.col("conv_id") % cycle == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % cycle, "h": (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")})
    # where the head is absent, null arrays would make the whole null
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", F.lit(1), F.lit(0)))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


class _Levels:
    """Nodes of one range, numbered level by level; node 0 is the root."""

    def __init__(self, conv: np.ndarray, size: np.ndarray, high: np.ndarray, low: np.ndarray, words: np.ndarray):
        n, at = len(conv), np.cumsum(size) - size
        none = np.flatnonzero(size == 0)
        none = none[np.argsort(conv[none], kind="stable")]
        level = {"parent": [-1], "least": [conv.min()], "count": [n], "words": [0], "depth": [0], "high": [0], "low": [0]}
        parts = [{k: np.array(v, np.int64) for k, v in level.items()}]
        ends = [(np.zeros(len(none), np.int64), conv[none])]
        self.bounds = [0, 1]
        rows, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        while True:
            on = size[rows] > depth
            rows, node = rows[on], node[on]
            if not len(rows):
                break
            width = int(min(WIDTH, size[rows].max() - depth))
            ids = np.full((2 * width, len(rows)), -1, np.int64)
            for c in range(width):
                has = size[rows] > depth + c
                place = at[rows[has]] + depth + c
                ids[2 * c, has], ids[2 * c + 1, has] = high[place], low[place]
            order = np.lexsort([conv[rows], *ids[::-1], node])
            rows, node, ids = rows[order], node[order], ids[:, order]
            own = conv[rows]
            new = np.ones(len(rows), bool)
            new[1:] = node[1:] != node[:-1]
            for c in range(width):
                depth += 1
                new[1:] |= (ids[2 * c, 1:] != ids[2 * c, :-1]) | (ids[2 * c + 1, 1:] != ids[2 * c + 1, :-1])
                starts = np.flatnonzero(new)
                there = ids[2 * c, starts] >= 0
                first = starts[there]
                count = np.add.reduceat(np.ones(len(rows), np.int64), starts)[there]
                place = at[rows[first]] + depth - 1
                parts.append({
                    "parent": node[first], "least": np.minimum.reduceat(own, starts)[there], "count": count, "words": words[place],
                    "depth": np.full(len(first), depth), "high": high[place], "low": low[place],
                })
                node = node.copy()
                node[ids[2 * c] >= 0] = np.repeat(np.arange(len(first)) + self.bounds[-1], count)
                done = size[rows] == depth
                ends.append((node[done], own[done]))
                self.bounds.append(self.bounds[-1] + len(first))
        for name in level:
            setattr(self, name, np.concatenate([p[name] for p in parts]))
        self.end_node, self.end_conv = (np.concatenate([e[i] for e in ends]) for i in (0, 1))
        self.total = self.bounds[-1]

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees; siblings stand next to each other in their level."""
        values = values.copy()
        for a, b in zip(self.bounds[-2:0:-1], self.bounds[:1:-1], strict=True):
            parent = self.parent[a:b]
            starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            values[parent[starts]] += np.add.reduceat(values[a:b], starts)
        return values

    def edges(self) -> dict[int, bytes]:
        """Nodes on the paths of the first and the last row, with the digest of their path."""
        first, last = np.full(self.total, -1), np.full(self.total, -1)
        numbers = np.arange(1, self.total)
        last[self.parent[1:]] = numbers
        first[self.parent[:0:-1]] = numbers[::-1]
        ending = np.zeros(self.total, bool)
        ending[self.end_node] = True
        keys = {0: ROOT}
        for child, stop in ((first, ending), (last, np.zeros(self.total, bool))):
            node = 0
            while not stop[node] and child[node] >= 0:
                above, node = keys[node], int(child[node])
                keys[node] = hashlib.blake2b(above + self.high[node].tobytes() + self.low[node].tobytes(), digest_size=16).digest()
        return keys


def _range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one range: complete ones, parts of those at its edges, and the conversations that end in these."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    ids, words = table.column("ids").combine_chunks(), table.column("words").combine_chunks()
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    t = _Levels(
        table.column("conv_id").to_numpy(), words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
        flat[0::2], flat[1::2], words.flatten().to_numpy(zero_copy_only=False),
    )
    keys = t.edges()
    edge = np.zeros(t.total, bool)
    edge[list(keys)] = True
    whole = ~edge
    children = np.bincount(t.parent[1:][whole[1:]], minlength=t.total)
    leaves = t.up(np.where(whole & (children == 0), 1, 0))
    saved = t.up(np.where(whole, (t.count - 1) * t.words, 0))

    shas = np.full(t.total, EMPTY, object)
    starts = np.flatnonzero(np.concatenate([[True], t.end_node[1:] != t.end_node[:-1]]))
    for a, b in zip(starts, [*starts[1:], len(t.end_node)], strict=True):
        if whole[node := t.end_node[a]]:
            shas[node] = hashlib.sha256(",".join(map(str, t.end_conv[a:b].tolist())).encode()).hexdigest()
    key = np.full(t.total, None, object)
    for i, k in keys.items():
        key[i] = k
    parent = np.maximum(t.parent, 0)
    root = t.parent < 0

    nodes = pa.RecordBatch.from_arrays([
        pa.array(np.where(whole, COMPLETE, EDGE), pa.int32()), pa.array(key, pa.binary()), pa.array(key[parent], pa.binary(), mask=root), pa.array(t.words),
        pa.array(t.least), pa.array(t.depth), pa.array(t.least[parent], mask=root | edge[parent]), pa.array(t.count), pa.array(children),
        pa.array(leaves), pa.array(saved), pa.array(shas, pa.string(), mask=edge),
    ], schema=_ARROW)
    for at in range(0, nodes.num_rows, 50_000):
        yield nodes.slice(at, 50_000)
    open_ends = np.flatnonzero(edge[t.end_node])
    for at in range(0, len(open_ends), 50_000):
        some = open_ends[at : at + 50_000]
        columns = {"kind": pa.array(np.full(len(some), END), pa.int32()), "key": pa.array(key[t.end_node[some]], pa.binary()), "conv_id": pa.array(t.end_conv[some])}
        yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(some), f.type)) for f in _ARROW], schema=_ARROW)


def _recombine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edge nodes of all ranges, by path: at most two paths per range."""
    nodes: dict[bytes, dict] = {}
    for batch in batches:
        for row in batch.to_pylist():
            node = nodes.setdefault(row["key"], row)
            if node is not row:
                node["conv_id"] = min(node["conv_id"], row["conv_id"])
                for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    node[name] += row[name]
    deepest = sorted(nodes.values(), key=lambda v: -v["depth"])
    own = {k: [0, 0] for k in nodes}  # leaves and tokens of edge nodes in the subtree
    for node in deepest:
        if node["parent_key"] is not None:
            nodes[node["parent_key"]]["n_children"] += 1
    for node in deepest:
        mine = own[node["key"]]
        mine[0] += node["n_children"] == 0
        mine[1] += (node["n_convs"] - 1) * node["words"]
        node["n_leaves"] += mine[0]
        node["saved_tokens"] += mine[1]
        if node["parent_key"] is not None:
            above = own[node["parent_key"]]
            above[0] += mine[0]
            above[1] += mine[1]
            node["parent_conv_id"] = nodes[node["parent_key"]]["conv_id"]
    if nodes:
        yield pa.RecordBatch.from_pylist(deepest, schema=_ARROW)


def trie(sequences: DataFrame) -> DataFrame:
    """One row per node of the trie of `sequences` (conv_id bigint, not null and unique; turns array<struct<h1, h2, words>>):
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ids = F.flatten(F.transform("turns", lambda t: F.array(t["h1"], t["h2"])))
    cut = land(sequences.select("conv_id", ids.alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words")), "rebuilt")
    parts = land(cut.repartitionByRange("ids", "conv_id").mapInArrow(_range, _PARTS), "trie")

    edges = land(parts.where(F.col("kind") == EDGE).coalesce(1).mapInArrow(_recombine, _PARTS), "edges")
    ends = parts.where(F.col("kind") == END).select("key", F.col("conv_id").alias("at"), F.col("conv_id").cast("string").alias("piece"))
    shas = joined_sha256(ends, "key", "at", "piece", ",", "ends")
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    at_edges = edges.join(shas, "key", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY))).select(names)

    complete = parts.where(F.col("kind") == COMPLETE)
    inner = complete.where("parent_key is null").select(names)
    above = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    under = complete.where("parent_key is not null").join(above, "parent_key").withColumn("parent_conv_id", F.col("above")).select(names)
    return inner.unionByName(under).unionByName(at_edges)
