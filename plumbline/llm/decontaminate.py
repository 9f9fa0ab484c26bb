"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Texts are compared as bytes after lower-casing A-Z and turning each run of ASCII space and punctuation into one space. The
segments of a benchmark item are its stretches of `SEGMENT` bytes at every offset (a shorter item is one segment); a segment
leaks into a document if some stretch of it is within `EDITS` of the segment's length in edit distance. Items of fewer than
`SHORTEST` bytes are common phrases and take no part, nor do items without an id.

Two texts of length m within e edits share at least m - q + 1 - q * e of their q-grams, on diagonals that lie within e of each
other. Documents are read once: each q-gram is looked up in the index of the items' q-grams; stretches that hold fewer hits than
the smallest such bound are left; in the others, hits are gathered per item in overlapping bands of diagonals (2 * (e + 1)
wide, every e + 1). In a band the segments of the item that hold as many hits as the bound asks are verified all at once: those
that stand there unchanged by comparing bytes, the others by an alignment that stays in the band.

The benchmark is the stated query set and is taken in blocks of at most `BLOCK` bytes, so a task's index is bounded whatever
the benchmark's size; the documents are read once per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import batches as B

GRAM, SEGMENT, SHORTEST, EDITS = 12, 80, 40, 0.05
BLOCK = 4_000_000
AT_ONCE = 2_000
PART = B.PIECE // 2
INSIDE, VALUE = B.byte_table(B.MARKS)
FOUND = "doc bigint, item_id bigint, start bigint, end bigint, n_segments bigint, edits bigint"


def plain(t: B.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalized bytes, their bounds by row, and where each byte stood."""
    inside = INSIDE[t.data]
    first = np.zeros(len(t.data) + 1, bool)
    first[t.bounds] = True
    before = np.append(False, inside[:-1]) & ~first[:-1] if len(inside) else inside
    keep = inside | before
    at = np.flatnonzero(keep)
    data = np.where(inside[at], VALUE[t.data[at]], 32).astype(np.uint8)
    return data, np.append(0, np.cumsum(keep))[t.bounds], at


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram that begins at each byte; `data` holds at most a piece."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(B.table("byte")[data] * B.table("up")[: len(data)], out=sums[1:])
    return B.mix((sums[q:] - sums[:-q]) * B.table("down")[: len(data) - q + 1])


def aligned(item: np.ndarray, begin: np.ndarray, size: int, data: np.ndarray, low: int, high: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the segments of `size` bytes at `begin`, those within `most` edits of a substring of `data` whose diagonals lie in
    low..high: which they are, the least edits and where that substring ends."""
    far = most + 1
    offsets = np.arange(high - low + 1)
    left = np.arange(len(begin))
    at = begin[:, None] + low + offsets  # place in the data before row i is at + i
    row = np.where((at >= 0) & (at <= len(data)), 0, far)
    for i in range(size):
        place = at + i
        ok = (place >= 0) & (place < len(data))
        change = np.where(ok, row + (data[np.clip(place, 0, max(len(data) - 1, 0))] != item[begin[left] + i][:, None]), far)
        skip = np.append(row[:, 1:], np.full((len(left), 1), far), 1) + 1  # the segment's byte is missing in the data
        row = np.minimum(np.minimum(change, skip), far)
        row = np.minimum.accumulate(row - offsets, 1) + offsets  # bytes only the data has
        row = np.where((place + 1 >= 0) & (place + 1 <= len(data)), row, far)
        good = row.min(1) <= most
        if not good.all():
            left, at, row = left[good], at[good], row[good]
            if not len(left):
                break
    best = row.argmin(1) if len(left) else left
    return left, row[np.arange(len(left)), best], begin[left] + low + best + size


class Index:
    """The items of a block and the places of their q-grams."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.item = [number for number, _ in items]
        self.bytes = [np.frombuffer(body, np.uint8) for _, body in items]
        length = np.array([len(b) for b in self.bytes])
        self.size = np.minimum(length, SEGMENT)
        self.edits = np.floor(self.size * EDITS).astype(np.int64)
        self.need = np.maximum(self.size - GRAM + 1 - GRAM * self.edits, 1)
        hashes = [np.concatenate([grams(b[at : at + PART + GRAM - 1], GRAM) for at in range(0, len(b), PART)]) for b in self.bytes]
        places = np.concatenate([np.arange(len(h)) for h in hashes])
        owners = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.place, self.owner = places[order], owners[order]
        self.index = B.HashIndex(keys)
        self.span, self.least = int((self.size + self.edits).max()), int(self.need.min())

    def search(self, data: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, segment's offset, first byte, byte after the last, edits) in normalized bytes of at most a piece."""
        found = self.index.find(grams(data, GRAM))
        hit = found >= 0
        if np.count_nonzero(hit) < self.least:
            return
        so_far = np.append(0, np.cumsum(hit))
        begin = np.arange(len(hit))
        dense = so_far[np.minimum(begin + self.span, len(hit))] - so_far[:-1] >= self.least
        # a hit counts if some dense stretch covers it
        marks = np.zeros(len(hit) + 1, np.int32)
        np.add.at(marks, begin[dense], 1)
        np.add.at(marks, np.minimum(begin[dense] + self.span, len(hit)), -1)
        at = np.flatnonzero(hit & (np.cumsum(marks[:-1]) > 0))
        key = found[at]
        where = B.ranges(self.first[key], self.count[key])
        at = np.repeat(at, self.count[key])
        item, place = self.owner[where], self.place[where]
        band = (at - place) // (self.edits[item] + 1)  # a hit lies in its band and in the one before, which is twice as wide as the step
        item, place, band = np.tile(item, 2), np.tile(place, 2), np.append(band, band - 1)
        once = np.unique(np.stack([item, band, place], 1), axis=0)
        pairs, first, counts = np.unique(once[:, :2], axis=0, return_index=True, return_counts=True)
        for g in np.flatnonzero(counts >= self.need[pairs[:, 0]]).tolist():
            k, b = pairs[g].tolist()
            own, size, e = self.bytes[k], int(self.size[k]), int(self.edits[k])
            low, places = b * (e + 1), once[first[g] : first[g] + counts[g], 2]
            # only an offset at which a hit enters or stays can hold enough of them
            offsets = np.unique(B.ranges(np.maximum(places - (size - GRAM), 0), np.minimum(places, len(own) - size) - np.maximum(places - (size - GRAM), 0) + 1))
            hits = np.searchsorted(places, offsets + size - GRAM, side="right") - np.searchsorted(places, offsets, side="left")
            offsets = offsets[hits >= self.need[k]]
            for x in range(0, len(offsets), AT_ONCE):
                yield from self._verified(k, own, offsets[x : x + AT_ONCE], size, data, low, e)

    def _verified(self, k: int, own: np.ndarray, offsets: np.ndarray, size: int, data: np.ndarray, low: int, e: int) -> Iterator[tuple[int, int, int, int, int]]:
        left, runs = np.ones(len(offsets), bool), np.arange(offsets[0], offsets[-1] + size)
        for d in range(low, low + 2 * (e + 1)):
            to = runs + d
            inside = (to >= 0) & (to < len(data))
            differ = np.append(0, np.cumsum(~inside | (data[np.clip(to, 0, len(data) - 1)] != own[runs])))
            exact = left & (differ[offsets - offsets[0] + size] == differ[offsets - offsets[0]])
            left &= ~exact
            for s in offsets[exact].tolist():
                yield k, s, s + d, s + d + size, 0
        offsets = offsets[left]
        if not len(offsets):
            return
        which, edits, ends = aligned(own, offsets, size, data, low - e, low + 2 * (e + 1) + e, e)
        for s, n, end in zip(offsets[which].tolist(), edits.tolist(), ends.tolist(), strict=True):
            yield k, s, max(0, end - size), end, n


def _blocks(benchmark: DataFrame, item_col: str, text: str) -> Iterator[list[tuple[int, bytes]]]:
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("bigint"), text).toLocalIterator():
        if row[0] is None or not row[1]:
            continue
        body = plain(B.texts(pa.array([row[1]])))[0].tobytes().strip()
        if len(body) < SHORTEST:
            continue
        if block and size + len(body) > BLOCK:
            yield block
            block, size = [], 0
        block.append((row[0], body))
        size += len(body)
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item of which a segment leaks: doc id, item_id, start and end (characters, from the
    first to the last segment found), n_segments (different offsets found), edits (the least of a segment).

    Null or empty texts hold nothing; repeated documents each get their rows; repeated items are reported under each id, and
    a repeated item id once. Without usable items the result is empty. Other columns are left out.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text).alias("text"))
    out = None
    for block in _blocks(benchmark, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], block: list[tuple[int, bytes]] = block) -> Iterator[pa.RecordBatch]:
            index = Index(block)
            for batch in B.slices(batches, "text", PART):
                t = B.texts(batch.column(1))
                data, bounds, at = plain(t)
                rows: dict[tuple[int, int], list] = {}
                overlap = index.span + SEGMENT
                for lo in range(0, max(len(data), 1), PART):  # a text longer than a part is searched in overlapping parts
                    part = data[lo : lo + PART + overlap]
                    for k, s, a, b, edits in index.search(part):
                        a, b = a + lo, b + lo
                        row = int(np.searchsorted(bounds, (a + b) // 2, side="right")) - 1
                        if a < bounds[row] - index.edits[k] or b > bounds[row + 1] + index.edits[k]:
                            continue  # it crosses from one document into the next
                        a, b = max(a, int(bounds[row])), min(b, int(bounds[row + 1]))
                        got = rows.setdefault((row, index.item[k]), [a, b, set(), edits])
                        got[0], got[1], got[3] = min(a, got[0]), max(b, got[1]), min(edits, got[3])
                        got[2].add((k, s))
                columns: tuple[list, ...] = ([], [], [], [], [], [])
                for (row, item), (a, b, seen, edits) in sorted(rows.items()):
                    begin = int(t.bounds[row])
                    chars = lambda x: int(np.count_nonzero((t.data[begin:x] & 0xC0) != 0x80))  # noqa: B023, E731
                    for column, value in zip(columns, (batch.column(0)[row].as_py(), item, chars(int(at[a])), chars(int(at[b - 1]) + 1), len(seen), edits), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "item_id", "start", "end", "n_segments", "edits"])

        part = chosen.mapInArrow(run, FOUND)
        out = part if out is None else out.union(part)
    out = spark.createDataFrame([], FOUND) if out is None else out
    return out.withColumnRenamed("doc", id_col)
