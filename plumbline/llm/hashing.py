"""Digests over many rows in order, without holding them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def joined_sha256(rows: DataFrame, key: str, order: str, piece: str, separator: str, name: str) -> DataFrame:
    """Per key the SHA-256 of its pieces by `order`, joined by a separator; pieces are not null.

    A digest is made byte after byte, so one task reads a key's rows; it reads them in Spark's sorted order and keeps one state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([last, pa.array([state.hexdigest()])], [key, name])

        last, state = None, None
        for batch in batches:
            keys, pieces = batch.column(key), batch.column(piece).to_pylist()
            for i, text in enumerate(pieces):
                own = keys.slice(i, 1)
                if state is not None and own.equals(last):
                    state.update(separator.encode())
                else:
                    if state is not None:
                        yield done()
                    last, state = own, hashlib.sha256()
                state.update(text.encode())
        if state is not None:
            yield done()

    placed = rows.select(key, order, piece).repartition(key).sortWithinPartitions(key, order).select(key, piece)
    return placed.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {name} string")
