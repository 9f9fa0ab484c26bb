"""Toxicity as multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A document is toxic if one of its sentences is. A sentence's probability is the logistic of a bias and the weights of its
lexicon entries; a document's is 1 - (1 - leak) * prod(1 - p) over its sentences that hold an entry, so sentences without any
do not add up in long texts. Only the document's label is known in training: the gradient of the noisy-or gives each sentence
its share of the blame, and the same sentence scores then locate the offending ones.

The lexicon is learned as well: words and word beginnings that labelled documents hold much more often when toxic (beginnings
let unseen inflections of a stem count). Training reads at most `SAMPLE` labelled rows per class, those with the smallest hash
of the id, and weights them back to the classes' true sizes; each round every partition improves the weights on its rows and
the results are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import batches as B
from plumbline.llm.store import land

SAMPLE, ENTRIES, ROUNDS, STEPS, BEGINNINGS = 5_000, 4_096, 3, 200, (4, 5, 6, 7)
LEAK = 0.001
KIND = B.byte_table(B.LETTERS)
ENDS = np.zeros(256, bool)
ENDS[list(b".!?\n")] = True
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


class Model(NamedTuple):
    """Hashes of the lexicon's entries, their weights, the bias of a sentence that holds any."""

    entries: np.ndarray
    weights: np.ndarray
    bias: float


def features(t: B.Texts) -> tuple[B.Words, np.ndarray]:
    """The words of lower-cased texts and, for each, the hashes of the word and of its beginnings (0: it is too short)."""
    w = B.words(t, KIND)
    out = np.zeros((len(w.hash), 1 + len(BEGINNINGS)), np.uint64)
    out[:, 0] = w.hash
    size, numbers = w.end - w.start, B.table("byte")[KIND[1]]
    h = np.full(len(w.hash), 0x51ED27, np.uint64)
    for j in range(max(BEGINNINGS)):
        inside = size > j
        byte = numbers[t.data[np.where(inside, w.start + j, 0)]] if len(t.data) else h
        h = (h ^ byte) * np.uint64(0xD1342543DE82EF95)
        if j + 1 in BEGINNINGS:
            out[:, 1 + BEGINNINGS.index(j + 1)] = np.where(inside, B.mix(h), 0)
    return w, out


def lowered(column: pa.Array) -> B.Texts:
    return B.texts(pc.utf8_lower(pc.fill_null(column, "")))


def sentences(t: B.Texts, w: B.Words) -> np.ndarray:
    """A number for the sentence of each word; those of two rows differ."""
    ends = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(ENDS[t.data], out=ends[1:])
    return ends[w.start] + w.row


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, train: Column, most: int) -> tuple[DataFrame, dict[int, float]]:
    """At most `most` labelled texts of each class, and the weight that gives each class its true size. An id with several labels counts as 1 if any is."""
    known = labels.where(train & F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    sizes = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    chosen = None
    for y in sizes:
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        chosen = known
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").select("_text", "_y")  # at most 2 * `most` ids
    return rows, {y: max(1.0, n / most) for y, n in sizes.items()}


def lexicon(rows: DataFrame, entries: int) -> np.ndarray:
    """Hashes of the entries that tell toxic from other texts best, by the log-likelihood ratio."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "_text", 2 * B.SLICE):
            w, f = features(lowered(batch.column(0)))
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            rows_of, flat = np.repeat(w.row, f.shape[1]), f.ravel()
            order = np.lexsort((rows_of, flat))
            flat, rows_of = flat[order], rows_of[order]
            once = np.ones(len(flat), bool)
            once[1:] = (flat[1:] != flat[:-1]) | (rows_of[1:] != rows_of[:-1])
            flat, toxic = flat[once], y[rows_of[once]]
            keys, at = np.unique(flat, return_index=True)
            if len(keys):
                pos = np.add.reduceat(toxic, at)
                n = np.diff(np.append(at, len(flat)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(pos), pa.array(n - pos)], ["entry", "pos", "neg"])

    n = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    if len(n) < 2:
        return np.zeros(0, np.uint64)
    a, b = F.col("pos"), F.col("neg")
    mean_a, mean_b = (a + b) * (n[1] / (n[0] + n[1])), (a + b) * (n[0] / (n[0] + n[1]))
    part = lambda x, mean: F.when(x > 0, x * F.log(x / mean)).otherwise(0.0)
    counts = rows.mapInArrow(count, "entry bigint, pos bigint, neg bigint").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = counts.where((F.col("entry") != 0) & (a >= 3) & ((a + 0.5) / (n[1] + 1) >= 8 * (b + 0.5) / (n[0] + 1)))
    top = counts.withColumn("gain", 2 * (part(a, mean_a) + part(b, mean_b))).where("gain >= 12").orderBy(F.desc("gain"), "entry").limit(entries)
    return np.array([r["entry"] for r in top.collect()], np.int64).view(np.uint64)  # `entries` numbers


def bags(batch: pa.RecordBatch, text: int, index: B.HashIndex) -> tuple[B.Texts, B.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Lexicon entries found: the word's place, its sentence, the entry; each entry once per sentence."""
    t = lowered(batch.column(text))
    w, f = features(t)
    hits, at = [], []
    for j in range(f.shape[1]):
        entry = index.find(f[:, j])
        here = np.flatnonzero(entry >= 0)
        hits.append(entry[here])
        at.append(here)
    entry, word = np.concatenate(hits), np.concatenate(at)
    sentence = sentences(t, w)[word] if len(word) else word
    order = np.lexsort((entry, sentence))
    entry, word, sentence = entry[order], word[order], sentence[order]
    once = np.ones(len(entry), bool)
    once[1:] = (entry[1:] != entry[:-1]) | (sentence[1:] != sentence[:-1])
    return t, w, word[once], sentence[once], entry[once]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def improve(docs: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, steps: int, class_weight: dict[int, float]) -> np.ndarray:
    """Gradient steps over some documents (label, sentence of each entry, entry); the last weight is the bias."""
    held = [d for d in docs if len(d[1])]
    if not held:
        return weights
    sent, row, base = [], [], 0
    for i, (_, s, _) in enumerate(held):
        _, inverse = np.unique(s, return_inverse=True)
        sent.append(inverse + base)
        row.append(np.full(inverse.max() + 1, i))
        base += int(inverse.max()) + 1
    sent, row = np.concatenate(sent), np.concatenate(row)
    entry = np.concatenate([e for *_, e in held])
    y = np.array([d[0] for d in held])
    cost = np.array([class_weight.get(int(v), 1.0) for v in y])
    w, past = weights.copy(), np.full(len(weights), 1e-6)
    for _ in range(steps):
        p = np.clip(_logistic(np.bincount(sent, w[entry], base) + w[-1]), 1e-9, 1 - 1e-9)
        clean = np.exp(np.bincount(row, np.log1p(-p), len(y))) * (1 - LEAK)
        blame = np.where(y == 1, clean / np.maximum(1 - clean, 1e-9), -1.0) * cost
        slope = p * blame[row]
        g = np.append(np.bincount(entry, slope[sent], len(w) - 1), slope.sum()) / len(y)
        g[:-1] -= 1e-4 * w[:-1]
        past += g * g
        w += 0.3 * g / np.sqrt(past)
    return w


def train(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from the labelled texts whose id meets `train`; without both classes, one that finds nothing."""
    rows, class_weight = labelled(docs, labels, id_col, text, label, train, sample)
    rows = land(rows, "labelled")
    entries = lexicon(rows, ENTRIES)
    if not len(entries):
        return Model(entries, np.zeros(0), -30.0)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = B.HashIndex(entries)
        for batch in B.slices(batches, "_text"):
            _, w, word, sentence, entry = bags(batch, 0, index)
            cut = np.searchsorted(w.row[word], np.arange(1, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(np.split(x, cut), pa.list_(pa.int64())) for x in (sentence, entry))], ["y", "sentence", "entry"])

    bag = rows.mapInArrow(sparse, "y int, sentence array<bigint>, entry array<bigint>").where(F.size("entry") > 0)  # the others have no gradient
    bag = land(bag.repartition(4, F.xxhash64("y", "sentence", "entry")), "bags")
    weights = np.full(len(entries) + 1, 1.0)
    weights[-1] = -3.0
    for _ in range(ROUNDS):
        start = weights

        def step(batches: Iterator[pa.RecordBatch], start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            held = [(r["y"], np.array(r["sentence"], np.int64), np.array(r["entry"], np.int64)) for b in batches for r in b.to_pylist()]
            out = improve(held, start, STEPS, class_weight)
            yield pa.RecordBatch.from_arrays([pa.array([len(held)]), pa.array([out.tobytes()], pa.binary())], ["n", "w"])

        got = bag.mapInArrow(step, "n bigint, w binary").collect()  # four vectors of weights
        total = sum(r["n"] for r in got)
        weights = sum(np.frombuffer(r["w"]) * r["n"] for r in got) / total if total else start
    return Model(entries, weights[:-1].copy(), float(weights[-1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", offending: float = 0.5) -> DataFrame:
    """The columns of `docs` and: score (0 to 1), sentences (start and end in characters, score) at `offending` or more.

    Null and empty texts, and texts without an entry, get the leak. Every row is kept. Input columns called `score` or
    `sentences` are replaced.
    """
    kept = docs.drop("score", "sentences")
    place = kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("sentences", SPANS)])
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = B.HashIndex(model.entries) if len(model.entries) else None
        for batch in B.slices(batches, text):
            clean, found = np.full(batch.num_rows, 1 - LEAK), [[] for _ in range(batch.num_rows)]
            if index is not None:
                t, w, word, sentence, entry = bags(batch, place, index)
                if len(word):
                    _, first, number = np.unique(sentence, return_index=True, return_inverse=True)
                    p = _logistic(np.bincount(number, model.weights[entry]) + model.bias)
                    row = w.row[word[first]]
                    np.multiply.at(clean, row, 1 - p)
                    for i in np.flatnonzero(p >= offending).tolist():
                        r, at = int(row[i]), int(w.start[word[first[i]]])
                        lo, hi = int(t.bounds[r]), int(t.bounds[r + 1])
                        before = np.flatnonzero(ENDS[t.data[lo:at]])
                        after = np.flatnonzero(ENDS[t.data[at:hi]])
                        a = lo + (int(before[-1]) + 1 if len(before) else 0)
                        b = at + int(after[0]) + 1 if len(after) else hi
                        chars = lambda x, y: int(np.count_nonzero((t.data[x:y] & 0xC0) != 0x80))  # noqa: B023, E731
                        start = chars(lo, a)
                        found[r].append({"start": start, "end": start + chars(a, b), "score": float(p[i])})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 - clean), pa.array(found, shape)], [*batch.schema.names, "score", "sentences"])

    return kept.mapInArrow(run, schema)
