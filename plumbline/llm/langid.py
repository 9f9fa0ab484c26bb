"""Language ID by words first, then by ever shorter character n-grams.

A word the model knows adds, for each language, its log frequency there. A word it does not know is scored through its
characters: each position takes the longest n-gram ending there (5, 4, … 1 characters, one of them may be the word's border)
that the model knows, and the word adds the mean of their log frequencies. The language with the largest sum wins.

The model is learned from about `SAMPLE` labelled rows per language, chosen by a hash of the id, and holds the `WORDS` most
frequent words and the `GRAMS` most frequent n-grams of each length per language; that bounds its size. Texts are lower-cased;
words are runs of letters.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import batches as B
from plumbline.llm.store import land

SAMPLE, WORDS, GRAMS, LONGEST = 4_000, 20_000, 8_000, 5
SLICE = 600_000
UNKNOWN = "und"
_K, _P = np.uint64(0x9E3779B97F4A7C15), 0xD1342543DE82EF95


class Model(NamedTuple):
    """Languages, hashes of words and n-grams (salted by length), and for each the log frequency in every language."""

    languages: list[str]
    features: np.ndarray
    logs: np.ndarray


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Spelled(NamedTuple):
    """Characters of a slice (0: no letter), sums of their hashes, the words' first and last position, their rows and hashes."""

    chars: np.ndarray
    sums: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    word: np.ndarray


def _salted(h: np.ndarray, n: int) -> np.ndarray:
    return B.mix(h ^ np.uint64((n + 1) * 0x1F123BB5159A55E5 & 0xFFFFFFFFFFFFFFFF))


def spell(column: pa.Array) -> Spelled:
    """Every row, lower-cased, as characters between zeros."""
    rows = [x.lower() for x in pc.fill_null(column, "").to_pylist()]
    chars = np.frombuffer("".join("\0" + x for x in rows).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32)
    inside = _letters()[chars]
    chars = np.where(inside, chars, 0)
    size = 1 << max(20, int(len(chars)).bit_length())
    up, down = (p[: len(chars)] for p in _powers(size))
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(B.mix((chars.astype(np.uint64) + np.uint64(1)) * _K) * up, out=sums[1:])
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    firsts = np.cumsum([1 + len(x) for x in rows]) if rows else np.zeros(0, np.int64)
    row = np.searchsorted(firsts, start, side="right")
    word = _salted((sums[end] - sums[start]) * down[start], 0)
    return Spelled(chars, sums, start, end, row, word)


def grams(s: Spelled, at: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For positions `at` in words that begin at `first`: whether an n-gram ends there (border included), and its hash."""
    lo = at - n + 1
    fits = lo >= first - 1
    if n == 1:
        fits &= s.chars[at] != 0  # a border alone says nothing
    lo = np.where(fits, lo, at)
    down = _powers(1 << max(20, int(len(s.chars)).bit_length()))[1]
    return fits, _salted((s.sums[at + 1] - s.sums[lo]) * down[lo], n)


def positions(s: Spelled, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the letters of some words and of the border behind each: position, first letter's position, number in `which`."""
    size = s.end[which] - s.start[which] + 1
    return B.ranges(s.start[which], size), np.repeat(s.start[which], size), np.repeat(np.arange(len(which)), size)


def counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, n, feature, count) over labelled texts; n is 0 for words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, text, 4 * SLICE):
            names = batch.column(0).to_pylist()
            for name in sorted(set(names)):
                s = spell(batch.column(1).filter(pa.array([x == name for x in names])))
                at, first, _ = positions(s, np.arange(len(s.start)))
                for n in range(LONGEST + 1):
                    if n:
                        fits, h = grams(s, at, first, n)
                        h = h[fits]
                    else:
                        h = s.word
                    keys, count = np.unique(h, return_counts=True)
                    if len(keys):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(np.full(len(keys), n)), pa.array(keys.view(np.int64)), pa.array(count)], ["lang", "n", "feature", "count"])

    return docs.select(lang, text).mapInArrow(run, "lang string, n bigint, feature bigint, count bigint").groupBy("lang", "n", "feature").agg(F.sum("count").alias("count"))


def train(docs: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from the rows that meet `train` and have a language. Without any, it knows no language."""
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # one row per language
    if not sizes:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
    share = F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, sample / n))))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 30)) / (1 << 30)
    seen = land(counts(rows.where(draw < F.try_element_at(share, F.col(lang))), lang, text), "counts")
    totals = {(r["lang"], r["n"]): (r["total"], r["kinds"]) for r in seen.groupBy("lang", "n").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("kinds")).collect()}
    order = Window.partitionBy("lang", "n").orderBy(F.desc("count"), "feature")
    most = F.when(F.col("n") == 0, WORDS).otherwise(GRAMS)
    top = seen.where("count > 1 or n = 0").withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(WORDS, GRAMS)).where(F.col("r") <= most)
    chosen = top.select("n", "feature").distinct()
    got = seen.join(chosen, ["n", "feature"]).select("lang", "n", "feature", "count").toArrow()  # at most (WORDS + LONGEST * GRAMS) * languages²
    languages = sorted(sizes)
    number = {k: i for i, k in enumerate(languages)}
    features = got.column("feature").to_numpy().view(np.uint64)
    keys, first, place = np.unique(features, return_index=True, return_inverse=True)
    n_of = got.column("n").to_numpy()[first]
    floor = {key: (0.5 / (total + 0.5 * kinds)) for key, (total, kinds) in totals.items()}
    logs = np.empty((len(keys), len(languages)), np.float64)
    for j, name in enumerate(languages):
        logs[:, j] = np.log([floor.get((name, n), 1e-9) for n in range(LONGEST + 1)])[n_of]
    which = np.array([number[x] for x in got.column("lang").to_pylist()], np.int64)
    added = got.column("count").to_numpy().astype(float)
    scale = np.array([[floor.get((name, n), 1e-9) / 0.5 for n in range(LONGEST + 1)] for name in languages])
    logs[place, which] = np.log((added + 0.5) * scale[which, n_of[place]]) if len(place) else 0
    return Model(languages, keys, logs.astype(np.float32))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of `docs` and lang_pred, score: the language, and its share of the likelihood of the whole text (0 to 1).

    `und` and 0 where the text is null or has no letter, or no language is known. Ties go to the first language by name.
    Every row is kept; input columns called lang_pred or score are replaced.
    """
    kept = docs.drop("lang_pred", "score")
    place = kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = B.HashIndex(model.features) if len(model.features) else None
        names = np.array([*model.languages, UNKNOWN])
        for batch in B.slices(batches, text, SLICE):
            s = spell(batch.column(place))
            kinds, once, number = np.unique(s.word, return_index=True, return_inverse=True)
            logs = np.zeros((len(kinds), len(model.languages)))
            if index is not None and len(kinds):
                found = index.find(kinds)
                logs[found >= 0] = model.logs[found[found >= 0]]
                new = np.flatnonzero(found < 0)
                at, first, owner = positions(s, once[new])
                gram = np.full(len(at), -1, np.int32)
                for n in range(LONGEST, 0, -1):
                    left = np.flatnonzero(gram < 0)
                    fits, h = grams(s, at[left], first[left], n)
                    left, h = left[fits], h[fits]
                    gram[left] = index.find(h)
                known = gram >= 0
                heard = np.maximum(np.bincount(owner[known], minlength=len(new)), 1)
                for j in range(len(model.languages)):
                    logs[new, j] = np.bincount(owner[known], model.logs[gram[known], j], len(new)) / heard
            total = np.stack([np.bincount(s.row, logs[number, j], batch.num_rows) for j in range(len(model.languages))], 1) if model.languages else np.zeros((batch.num_rows, 1))
            share = np.exp(total - total.max(1, keepdims=True))
            share = share.max(1) / share.sum(1)
            none = (np.bincount(s.row, minlength=batch.num_rows) == 0) | (not model.languages)
            best = np.where(none, len(names) - 1, total.argmax(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best].tolist(), pa.string()), pa.array(np.where(none, 0.0, share))], [*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)
