"""Exact top-k inner products with a pivot table.

Every vector's distances to a few pivots are computed once. For a query q and a candidate x, the largest |d(q, p) - d(x, p)|
over the pivots p bounds d(q, x) from below, and with it the inner product (|q|² + |x|² - d²) / 2 from above. Candidates are
scored in the order of that bound until the k-th best score so far exceeds the next bound, so what is left out cannot count.

Vectors are cut into blocks of numbers. Each query block meets each candidate block: both carry the pair (query block, share),
the queries once per share and the candidates once per query block, and a task gets one query block and the few candidate
blocks of one share. Only each share's k best per query leave a task; a window with a pushed-down limit keeps the k best of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.store import land

PIVOTS, SAMPLE, QUERIES, CANDIDATES, SHARE = 16, 1024, 1024, 4096, 8
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1


def _norm(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.einsum("...i,...i->...", x, x)


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Far-apart rows of the sample: each next one is the row farthest from those chosen."""
    if not len(sample):
        return sample
    chosen = [0]
    away = _norm(sample - sample[0])
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(np.argmax(away)))
        away = np.minimum(away, _norm(sample - sample[chosen[-1]]))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(_norm(x - p)) for p in pivots], 1) if len(pivots) else np.zeros((len(x), 0))


def best(q: np.ndarray, q_far: np.ndarray, x: np.ndarray, x_far: np.ndarray, x_norm: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (score, id) of candidates x for one query, and how many were scored. `own` marks candidates left out."""
    q_norm = float(q @ q)
    bound = np.zeros(len(x))
    for j in range(len(q_far)):
        np.maximum(bound, np.abs(x_far[:, j] - q_far[j]), out=bound)
    total = q_norm + x_norm
    bound = np.maximum(bound * (1 - 1e-9) - 1e-6, 0)
    upper = (total - bound * bound) * 0.5 + total * 1e-9 + 1e-6
    upper[own] = -np.inf
    order = np.argsort(-upper, kind="stable")[: len(x) - int(own.sum())]
    scores, at, step = np.empty(0), 0, 256
    while at < len(order):
        if at >= k and np.partition(scores, at - k)[at - k] > upper[order[at]]:
            break
        part = order[at : at + step]
        scores = np.append(scores, x[part] @ q)
        at, step = at + len(part), step * 2
    seen = order[:at]
    top = np.lexsort((ids[seen], -scores))[:k]
    return scores[top], ids[seen][top], at


def exact_best(q: np.ndarray, x: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[int], np.ndarray]:
    """The same over whole numbers of any size, for vectors whose products do not fit a double; scores end at the range of a long."""
    keep = np.flatnonzero(~own)
    whole = [int(v) for v in q]
    scores = [min(max(sum(a * int(b) for a, b in zip(whole, row, strict=True)), LEAST), MOST) for row in x[keep]]
    order = sorted(range(len(keep)), key=lambda i: (-scores[i], ids[keep[i]]))[:k]
    return [scores[i] for i in order], ids[keep[order]] if order else np.zeros(0, np.int64)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows with the largest inner product of floor(scale * component).

    Rows with a null id or vector, or with a null or non-finite component, take no part, neither do empty vectors; vectors of
    different lengths are not compared. A query does not meet rows of its own id. Ties go to the smaller id. Repeated
    candidates each count; a query row that repeats is answered once. Other columns are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.withColumns({"_id": F.col(id_col).cast("bigint"), "_v": F.col(vector).cast("array<double>"), "_q": is_query}).select("_id", "_v", "_q")
    limit = F.lit(float("inf"))
    rows = rows.where(F.col("_id").isNotNull() & (F.size("_v") > 0) & F.forall("_v", lambda c: c.isNotNull() & (F.abs(c) < limit) & ~F.isnan(c)))
    
    def whole(values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(np.floor(scale * np.asarray(values, float)), -1e308, 1e308)

    # pivots: far-apart rows of a sample of at most SAMPLE rows, by hash of the id
    sample = rows.orderBy(F.xxhash64("_id", "_v")).limit(SAMPLE).select("_v").collect()
    pivots = {}
    for size in {len(r["_v"]) for r in sample}:
        pivots[size] = choose_pivots(whole([r["_v"] for r in sample if len(r["_v"]) == size]))

    def blocks(most: int):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}

            def out(size: int, parts: list) -> pa.RecordBatch:
                ids, x = (np.concatenate(p) for p in zip(*parts, strict=True))
                far = distances(x, pivots.get(size, np.zeros((0, size))))
                return pa.RecordBatch.from_arrays(
                    [pa.array([size]), pa.array([int(ids[0])]), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (ids, x, far))],
                    ["size", "first", "ids", "x", "far"],
                )

            for batch in batches:
                ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                sizes = column.value_lengths().to_numpy(zero_copy_only=False)
                for size in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == size)
                    x = whole(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)).reshape(-1, size)
                    for lo in range(0, len(at), most):
                        parts = held.setdefault(size, [])
                        parts.append((ids[at[lo : lo + most]], x[lo : lo + most]))
                        while (n := sum(len(p[0]) for p in parts)) >= most:
                            joined = tuple(np.concatenate(p) for p in zip(*parts, strict=True))
                            yield out(size, [tuple(a[:most] for a in joined)])
                            parts[:] = [tuple(a[most:] for a in joined)] if n > most else []
            for size, parts in held.items():
                if sum(len(p[0]) for p in parts):
                    yield out(size, parts)

        return cut

    shape = "size bigint, first bigint, ids binary, x binary, far binary"
    asked = rows.where("_q").select("_id", "_v").distinct()
    n = asked.count()
    asked = asked.repartition(max(1, -(-n // QUERIES)), "_id").mapInArrow(blocks(QUERIES), shape)
    asked = land(asked, "query-blocks")
    there = rows.select("_id", "_v").mapInArrow(blocks(CANDIDATES), shape)
    # numbers of blocks, a few thousandths of the rows
    q_blocks = [(r["size"], r["first"]) for r in asked.select("size", "first").collect()]
    shares = max(1, -(-rows.count() // (CANDIDATES * SHARE)))
    numbered = spark.createDataFrame([(s, f, i) for i, (s, f) in enumerate(q_blocks)], "size bigint, first bigint, block bigint")
    spread = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    left = asked.join(numbered, ["size", "first"]).select("block", spread, "ids", "x", "far")
    per_size = numbered.groupBy("size").agg(F.collect_list("block").alias("list"))
    right = there.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int")).join(per_size, "size").select(F.explode("list").alias("block"), "share", "ids", "x", "far")

    def meet(_key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], list] = {}
        got = [queries.column(c).to_pylist() for c in ("ids", "x", "far")]
        others = [[np.frombuffer(b) if c != "ids" else np.frombuffer(b, np.int64) for b in candidates.column(c).to_pylist()] for c in ("ids", "x", "far")]
        for raw in zip(*got, strict=True):
            q_ids = np.frombuffer(raw[0], np.int64)
            q = np.frombuffer(raw[1]).reshape(len(q_ids), -1)
            q_far = np.frombuffer(raw[2]).reshape(len(q_ids), -1)
            for ids, x, far in zip(*others, strict=True):
                x, far = x.reshape(len(ids), -1), far.reshape(len(ids), -1)
                x_norm = _norm(x)
                fits = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < EXACT and float(x_norm.max()) < EXACT
                for i, own in enumerate(q_ids.tolist()):
                    out = best(q[i], q_far[i], x, far, x_norm, ids == own, ids, k)[:2] if fits else exact_best(q[i], x, ids == own, ids, k)
                    found.setdefault((own, int.from_bytes(blake2b(q[i].tobytes(), digest_size=7).digest(), "little")), []).append(([int(s) for s in out[0]], out[1].tolist()))
        columns: tuple[list, ...] = ([], [], [], [])
        for (own, which), parts in found.items():
            top = sorted(((-s, i) for scores, ids in parts for s, i in zip(scores, ids, strict=True)))[:k]
            for c, values in zip(columns, ([own] * len(top), [which] * len(top), [i for _, i in top], [-s for s, _ in top]), strict=True):
                c.extend(values)
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "which", "vec_id", "score"])

    met = left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(meet, "query_id bigint, which bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
