"""License scans: phrases at exact places, and templates found in text blocks by an exact set-similarity join.

A block is a line, or a stretch of hard-wrapped lines: a line goes on in the next one if, from its first word on, it would be
`WRAPPED` bytes or more with what stands before that one's first space; a line without words ends the stretch. Around each such line break the template's words, with a quarter
and four more for words in between, are a block on either side, as far as the lines go on; so a notice of any length is whole
in some block wherever its lines break. A template is met by a block that holds at least `threshold` of the template's distinct words. The join
is filter and verify: words are ordered by how many blocks of the whole corpus hold them, rarest first (first pass); a block
that meets a template of n words, of which m = ceil(threshold * n) are needed, must hold one of the n - m + 1 rarest, so only
blocks with such a prefix word are looked at (second pass); of those, blocks with fewer than m words go (length filter), then
those where the places left after the first shared word, in the block's or the template's order, cannot make up m (positional
filter); what remains is counted exactly. Words outside all templates cannot add to the overlap and take no place in the order.

The templates are a parameter, not a table that grows: at most `MOST_WORDS` distinct words, else `scan` refuses.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import batches as B

MOST_WORDS = 100_000
WRAPPED = 40
KIND = B.byte_table(B.MARKS)
SPACE = ~B.byte_table(B.SPACES)[0]

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Common wordings of licence notices and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at www.apache.org/licenses/LICENSE-2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
]

BLOCK = "struct<label:string,first_word:bigint,last_word:bigint,containment:double>"


def _hashes(text: str) -> np.ndarray:
    return B.words(B.texts(pa.array([text])), KIND).hash


def _blocks(t: B.Texts, w: B.Words) -> np.ndarray:
    """Number of the line of each word; lines of two rows never share a number."""
    lines = np.zeros(len(t.data) + 1, np.int32)
    np.cumsum(t.data == 10, out=lines[1:])
    return lines[w.start].astype(np.int64) + w.row


def _breaks(t: B.Texts, w: B.Words, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that open a line in which a wrapped line goes on, and for each the first word of its stretch of lines and the word after the last."""
    opens = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    closes = np.append(opens[1:], len(block)) - 1
    spaces = np.append(np.flatnonzero(SPACE[t.data]), len(t.data))
    full = w.end[closes[:-1]] - w.start[opens[:-1]] + 1 + spaces[np.searchsorted(spaces, w.start[opens[1:]])] - w.start[opens[1:]] >= WRAPPED
    on = np.append(False, full & (block[opens[1:]] - block[closes[:-1]] == 1) & (w.row[opens[1:]] == w.row[closes[:-1]]))
    first = np.flatnonzero(~on)
    stretch = np.cumsum(~on) - 1
    ends = np.append(opens[first[1:]], len(block))
    return opens[on], opens[first][stretch[on]], ends[stretch[on]]


def frequencies(docs: DataFrame, text: str, vocabulary: np.ndarray) -> np.ndarray:
    """In how many blocks of all rows each word of the vocabulary stands."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = B.HashIndex(vocabulary), np.zeros(len(vocabulary), np.int64)
        for batch in B.slices(rows, text):
            t = B.texts(batch.column(0))
            w = B.words(t, KIND)
            place = index.find(w.hash)
            hit = place >= 0
            pairs = np.unique(_blocks(t, w)[hit] * len(vocabulary) + place[hit])
            total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(total)], ["word", "n"])

    counts = docs.select(text).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary), np.int64)
    for row in counts.collect():  # one row per template word
        out[row["word"]] = row["n"]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None,
         templates: list[tuple[str, str]] | None = None, threshold: float = 0.9) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels and labels (sorted arrays), score, blocks.

    `blocks` lists every (block, label) that meets a template, with the block's first and last word and the best share. The
    score is 1 where a phrase stands, else the best share of a block, else 0. Null or wordless texts have no words, labels or
    blocks; repeated rows each get a row; other columns are left out.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    spelled = [(_hashes(p), label) for p, label in phrases.items()]
    sets = [(label, np.unique(_hashes(text_))) for label, text_ in templates]
    wide = [5 * len(_hashes(text_)) // 4 + 4 for (_, text_), (_, s) in zip(templates, sets, strict=True) if len(s)]
    sets = [(label, s) for label, s in sets if len(s)]
    vocabulary = np.unique(np.concatenate([s for _, s in sets])) if sets else np.zeros(0, np.uint64)
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"the templates hold more than {MOST_WORDS} words; scan them in parts")
    often = frequencies(docs, text, vocabulary) if sets else vocabulary
    vocabulary = vocabulary[np.lexsort((vocabulary, often))]  # position is now the global order
    place_of = {h: k for k, h in enumerate(vocabulary.tolist())}
    rules = []
    for (label, s), reach in zip(sets, wide, strict=True):
        order = np.sort([place_of[h] for h in s.tolist()])
        need = math.ceil(threshold * len(order) - 1e-9)
        rules.append((label, order, need, order[: len(order) - need + 1], reach))
    schema = f"id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, blocks array<{BLOCK}>"

    def meets(rule: tuple, words: np.ndarray, place: np.ndarray) -> float | None:
        """The share of a template's words in a block, if it is enough."""
        _, order, need, prefix, _ = rule
        own = np.unique(place)
        own = own[own >= 0]
        shared = np.isin(prefix, own)
        if not shared.any() or len(np.unique(words)) < need:
            return None
        i = int(np.argmax(shared))
        j = int(np.searchsorted(own, prefix[i]))
        if 1 + min(len(order) - i - 1, len(own) - j - 1) < need:
            return None
        overlap = len(np.intersect1d(order, own, assume_unique=True))
        return overlap / len(order) if overlap >= need else None

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = B.HashIndex(vocabulary) if sets else None
        prefix_words = np.zeros(len(vocabulary) + 1, bool)
        for *_, prefix, _ in rules:
            prefix_words[prefix] = True
        for batch in B.slices(rows, text):
            t = B.texts(batch.column(1))
            w = B.words(t, KIND)
            base = np.bincount(w.row, minlength=t.rows)
            first_of = np.cumsum(base) - base
            number = np.arange(len(w.hash)) - first_of[w.row]
            n_base, first, last = np.zeros(t.rows, np.int64), np.full(t.rows, np.iinfo(np.int64).max), np.full(t.rows, -1)
            labels: list[set[str]] = [set() for _ in range(t.rows)]
            for spelling, label in spelled:
                k = len(spelling)
                starts = np.flatnonzero(w.hash[: max(0, len(w.hash) - k + 1)] == spelling[0])
                for j in range(1, k):
                    starts = starts[(w.hash[starts + j] == spelling[j]) & (w.row[starts + j] == w.row[starts])]
                np.add.at(n_base, w.row[starts], 1)
                np.minimum.at(first, w.row[starts], number[starts])
                np.maximum.at(last, w.row[starts], number[starts])
                for r in np.unique(w.row[starts]).tolist():
                    labels[r].add(label)
            met: list[dict] = [{} for _ in range(t.rows)]
            if sets and len(w.hash):
                place, block = index.find(w.hash), _blocks(t, w)
                marked = np.unique(block[prefix_words[place] & (place >= 0)])
                for b in marked.tolist():
                    lo, hi = np.searchsorted(block, [b, b + 1])
                    for rule in rules:
                        if share := meets(rule, w.hash[lo:hi], place[lo:hi]):
                            r, key = int(w.row[lo]), (rule[0], int(number[lo]), int(number[hi - 1]))
                            met[r][key] = max(share, met[r].get(key, 0.0))
                marks = np.append(0, np.cumsum(prefix_words[place] & (place >= 0)))
                at, first_word, after = _breaks(t, w, block)
                for rule in rules:
                    begin, stop = np.maximum(first_word, at - rule[4]), np.minimum(after, at + rule[4])
                    for k in np.flatnonzero(marks[stop] > marks[begin]).tolist():
                        lo, hi = int(begin[k]), int(stop[k])
                        if share := meets(rule, w.hash[lo:hi], place[lo:hi]):
                            own = lo + np.flatnonzero(np.isin(place[lo:hi], rule[1]))
                            r, a, z = int(w.row[lo]), int(number[own[0]]), int(number[own[-1]])
                            near = [x for x in met[r] if x[0] == rule[0] and x[1] <= z and a <= x[2]]
                            if all(met[r][x] < share for x in near):  # of blocks that overlap the best stays
                                for x in near:
                                    del met[r][x]
                                met[r][rule[0], a, z] = share
            has = n_base > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(base), pa.array(n_base), pa.array(first, mask=~has), pa.array(last, mask=~has),
                    pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                    pa.array([[dict(zip(("label", "first_word", "last_word", "containment"), (*k, v), strict=True)) for k, v in sorted(x.items())] for x in met],
                             pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())]))),
                ],
                ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"],
            )

    found = docs.select(F.col(id_col).cast("bigint").alias("id"), text).mapInArrow(find, schema)
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("blocks", lambda b: b["label"])))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))).alias("score"),
        "blocks",
    )
