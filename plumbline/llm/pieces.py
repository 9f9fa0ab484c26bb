"""SentencePiece encoding and decoding through a table of distinct chunks.

When no piece of a model holds a white-space marker after another character, no merge crosses from the end of a word into the
marker of the next, so a text falls into chunks (a run of markers and the characters up to the next marker) that the model
segments one by one. Each slice of texts lists its chunks in order, keeps every distinct chunk once, segments only those (a
table of earlier chunks is kept per worker, `CACHED` at most), and puts the ids back by position.

Models for which this does not hold (other normalization, no dummy prefix, pieces across markers, user-defined symbols) are
encoded text by text. Null counts as an empty text; an empty text gives only the begin and end ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from plumbline.llm import batches as B

MARKER = "▁"
CACHED = 150_000
_loaded: dict[str, Encoder] = {}


class Encoder:
    """One model in a worker, with its table of distinct chunks."""

    def __init__(self, model_file: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        rules, trainer = proto.normalizer_spec, proto.trainer_spec
        self.chunked = (
            rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces and not rules.precompiled_charsmap
            and not trainer.treat_whitespace_as_suffix and trainer.model_type in (1, 2)
            and all(p.type != p.USER_DEFINED and MARKER not in p.piece.lstrip(MARKER) for p in proto.pieces)
        )
        self.known: dict[str, list[int]] = {}
        lone = self.model.piece_to_id(MARKER)
        self.lone = [lone] if lone != self.model.unk_id() else [self.model.piece_to_id(f"<0x{b:02X}>") for b in MARKER.encode()]

    @classmethod
    def of(cls, model_file: str) -> Encoder:
        if model_file not in _loaded:
            _loaded[model_file] = cls(model_file)
        return _loaded[model_file]

    def table(self, chunks: list[str]) -> list[list[int]]:
        """Ids of distinct chunks, each of which begins with a marker."""
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > CACHED:
            self.known, new = {}, chunks
        # the model itself puts a marker before what it is given, so the first is left out
        self.known.update(zip(new, self.model.encode([c[1:] for c in new], num_threads=1), strict=True))
        if " " in self.known:
            self.known[" "] = self.lone
        return [self.known[c] for c in chunks]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, without begin and end, and how many each row has."""
        column = pc.fill_null(column, "")
        if not self.chunked:
            rows = self.model.encode(column.to_pylist(), num_threads=1)
            return np.fromiter((i for r in rows for i in r), np.uint32), np.array([len(r) for r in rows], np.int64)
        t = B.texts(pc.replace_substring(column, MARKER, " "))
        size = np.diff(t.bounds)
        full = size > 0
        # a marker before each text that is not empty
        bounds = np.concatenate([[0], np.cumsum(size + full)])
        data = np.full(bounds[-1], 32, np.uint8)
        data[B.ranges((bounds[:-1] + 1)[full], size[full])] = t.data
        space = data == 32
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[bounds[:-1][full]] = True
        start = np.flatnonzero(opens)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(t.rows, np.int64)
        offsets = np.append(start, len(data))
        listed = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        ids = self.table(listed.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for r in ids for i in r), np.uint32, int(lengths.sum()))
        place = listed.indices.to_numpy()
        took = lengths[place]
        row = np.searchsorted(bounds, start, side="right") - 1
        return flat[B.ranges((np.cumsum(lengths) - lengths)[place], took)], np.bincount(row, took, t.rows).astype(np.int64)


def encode(df: DataFrame, model_file: str, text: str = "text", ids: str = "ids", begin: bool = True, end: bool = True, packed: bool = False) -> DataFrame:
    """The rows with the column `ids`: an array of ids, or with `packed` the ids as little-endian 32-bit numbers in one binary.

    A column that is already called `ids` is replaced. Every row is kept, repeated ones too.
    """
    kept = df.drop(ids)
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(model_file)
        bos, eos = encoder.model.bos_id(), encoder.model.eos_id()
        for batch in B.slices(rows, text):
            flat, counts = encoder.encode(batch.column(batch.schema.get_field_index(text)))
            bounds = np.concatenate([[0], np.cumsum(counts + begin + end)])
            out = np.empty(bounds[-1], np.uint32)
            out[B.ranges(bounds[:-1] + begin, counts)] = flat
            if begin:
                out[bounds[:-1]] = bos
            if end:
                out[bounds[1:] - 1] = eos
            column = B.binary(out.astype("<u4").view(np.uint8), bounds * 4).cast(pa.binary()) if packed else pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(out.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, ids])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids, kind)]))


def decode(df: DataFrame, model_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the column `text`: what the model makes of an `ids` column, packed or an array. Null gives an empty text."""
    kept = df.drop(text)
    packed = isinstance(df.schema[ids].dataType, T.BinaryType)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Encoder.of(model_file).model
        for batch in rows:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                values = part.column(part.schema.get_field_index(ids))
                listed = [np.frombuffer(v.as_buffer(), "<u4").tolist() if v.is_valid else [] for v in values] if packed else [v or [] for v in values.to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([model.decode(v) if v else "" for v in listed], pa.string())], [*part.schema.names, text])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())]))
