"""Helpers that the text operators run inside tasks: Arrow batches in bounded slices, words of raw UTF-8 bytes, hash look-ups.

Texts stay UTF-8 bytes in one buffer per slice, and every step over them is one numpy pass, so no Python object is made per
word. A slice holds at most `SLICE` bytes or one text; words are hashed in pieces of `PIECE` bytes, so the temporary arrays of
a very long text stay bounded too.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1_000_000
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD1342543DE82EF95


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[str, np.ndarray] = {}


def table(name: str) -> np.ndarray:
    """Powers of the base, of its inverse, and a random number for every byte; made once per worker."""
    if not _tables:
        _tables["up"] = _powers(_BASE, PIECE + 1)
        _tables["down"] = _powers(_INVERSE, PIECE + 1)
        _tables["byte"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
    return _tables[name]


class Texts(NamedTuple):
    """UTF-8 bytes of a slice of rows; row i is data[bounds[i]:bounds[i + 1]]."""

    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def texts(column: pa.Array) -> Texts:
    """The bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return Texts(raw, bounds - bounds[0])


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a slice holds at most `most` bytes of text or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


class Words(NamedTuple):
    """Words in order: 64-bit hash, first byte, byte after the last, row."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def byte_table(separators: str | bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it belongs to a word, and the byte it counts as (A-Z as a-z)."""
    inside, value = np.ones(256, bool), np.arange(256, dtype=np.uint8)
    inside[list(separators if isinstance(separators, bytes) else separators.encode("latin-1"))] = False
    if lower:
        value[65:91] += 32
    return inside, value


SPACES = bytes([0x20, *range(0x09, 0x0E)])
MARKS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LETTERS = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def words(t: Texts, kind: tuple[np.ndarray, np.ndarray]) -> Words:
    """Maximal runs of word bytes inside each row."""
    inside, value = kind
    n = len(t.data)
    first = np.zeros(n + 1, bool)
    first[t.bounds] = True
    numbers = table("byte")[value]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    joins: list[int] = []
    count = 0
    for at in range(0, n, PIECE):
        part = t.data[at : at + PIECE]
        m = len(part)
        is_in = inside[part]
        before = np.empty(m, bool)
        before[0] = False
        before[1:] = is_in[:-1]
        opens = is_in & (~before | first[at : at + m])
        after = np.empty(m, bool)
        after[-1] = False
        after[:-1] = is_in[1:]
        closes = is_in & (~after | first[at + 1 : at + m + 1])
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum(numbers[part] * table("up")[:m], out=sums[1:])
        h = (sums[e] - sums[s]) * table("down")[s]
        if at and len(s) and s[0] == 0 and count and found[-1][1][-1:] == at and not first[at]:
            joins.append(count)
        found.append((s + at, e + at, h))
        count += len(s)
    if not count:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none)
    start, end, h = (np.concatenate(x) for x in zip(*found, strict=True))
    for k in reversed(joins):  # a word that goes on in the next piece
        shift = pow(_BASE, int(end[k - 1] - start[k - 1]), 1 << 64)
        h[k - 1] = np.uint64((int(h[k - 1]) + shift * int(h[k])) & 0xFFFFFFFFFFFFFFFF)
        end[k - 1] = end[k]
    if joins:
        start, end, h = (np.delete(x, joins) for x in (start, end, h))
    row = np.searchsorted(t.bounds, start, side="right") - 1
    return Words(mix(h ^ (end - start).astype(np.uint64) * np.uint64(_STEP)), start, end, row)


def hash_of(word: str, kind: tuple[np.ndarray, np.ndarray]) -> np.uint64:
    """The hash that `words` gives to one word."""
    found = words(texts(pa.array([word])), kind)
    if len(found.hash) != 1:
        raise ValueError(f"{word!r} is not one word")
    return found.hash[0]


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` neighbouring words."""
    n = len(h) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        if n > 0:
            out = out * np.uint64(_STEP) + h[k : k + n]
    return mix(out)


class HashIndex:
    """Positions of 64-bit keys, looked up for whole arrays. A table of single bits turns most misses away first."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, np.uint64)
        bits = max(10, int(np.ceil(np.log2(4 * len(self.keys) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        wait, at = np.arange(len(self.keys), dtype=np.int32), (self.keys >> self.shift).astype(np.int64)
        while len(wait):
            free = self.slots[at] < 0
            self.slots[at[free][::-1]] = wait[free][::-1]
            left = self.slots[at] != wait
            wait, at = wait[left], (at[left] + 1) & self.mask
        self.filter_shift = np.uint64(64 - 20)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> self.filter_shift).astype(np.int64)] = True

    def find(self, asked: np.ndarray) -> np.ndarray:
        """For each key its position, or -1."""
        out = np.full(len(asked), -1, np.int32)
        left = np.flatnonzero(self.filter[(asked >> self.filter_shift).astype(np.int64)])
        at = (asked[left] >> self.shift).astype(np.int64)
        while len(left):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[slot] == asked[left])
            out[left[hit]] = slot[hit]
            on = (slot >= 0) & ~hit
            left, at = left[on], (at[on] + 1) & self.mask
        return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, … for lengths[i] places, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow binary array."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
