"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, and a check on the full sets.

A document's set holds its distinct runs of five words (`[^\\x20\\x09-\\x0D]+` after lower-casing A-Z); with fewer words the whole
sequence is the one member; without words the set is empty and linked with nothing. Documents are linked when
100 * intersection >= 75 * union.

A signature has 48 MinHash values of 16 bits; the distance of two is the number of values that differ, at Jaccard 0.75 on
average 12 with a deviation of 3. It is split into 12 chunks of 4. By the pigeonhole, two signatures at a distance of at most
23 have a chunk with at most one error, so each signature is filed under each chunk with each of its values left out (the
allowed errors enumerated): 48 keys, and every pair within 23 shares one. A pair that is linked is missed only if at least two
values differ in every chunk, about once in ten million pairs at Jaccard 0.75, less often above.

Sets equal as sets are one class from the start. No bucket is expanded into pairs: its members are compared with one pivot,
each member with the pivot nearest to it by signature, and confirmed links merge components. Buckets that hold one component
are done. Documents in buckets that still hold several are joined exactly on the rarest elements of their full sets, across
components only. Nothing is dropped or capped on the way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import batches as B
from plumbline.llm.components import components
from plumbline.llm.rows import keyed, unpacked
from plumbline.llm.store import land, land_by

SIZE, CHUNKS, WIDTH = 5, 12, 4
VALUES, NEAR = CHUNKS * WIDTH, 2 * CHUNKS - 1
SLOTS, CLASSES = 1 << 20, 3
KIND = B.byte_table(B.SPACES)


def shingles(t: B.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct members of each row's set, in order of row and hash: (row, hash)."""
    w = B.words(t, KIND)
    n = np.bincount(w.row, minlength=t.rows)
    first = np.cumsum(n) - n
    h = B.runs(w.hash, SIZE)
    row = w.row[: len(h)]
    whole = w.row[SIZE - 1 :] == row if len(h) else np.zeros(0, bool)
    h, row = h[whole], row[whole]
    few = np.flatnonzero((n > 0) & (n < SIZE))
    for size in range(1, SIZE):
        at = few[n[few] == size]
        if len(at):
            own = np.zeros(len(at), np.uint64)
            for k in range(size):
                own = own * np.uint64(0xD1342543DE82EF95) + w.hash[first[at] + k]
            h, row = np.append(h, B.mix(own ^ np.uint64(size))), np.append(row, at)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[once], h[once]


def signatures(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """rows x VALUES of 16 bits; zeros for empty sets."""
    out = np.zeros((rows, VALUES), np.uint16)
    if len(h):
        at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        scale = B.mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
        for k in range(VALUES):
            least = np.minimum.reduceat((h ^ (scale[k] >> np.uint64(7))) * scale[k], at)
            out[row[at], k] = (B.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def describe(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, n, two numbers that name the set, packed signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, text):
            t = B.texts(batch.column(1))
            row, h = shingles(t)
            n = np.bincount(row, minlength=t.rows)
            names = []
            for salt in (0x1F0E3DAD, 0x68D30A9594728BC4):
                sums = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(B.mix(h ^ np.uint64(salt)), out=sums[1:])
                ends = np.cumsum(n)
                names.append((sums[ends] - sums[ends - n]).view(np.int64))
            packed = B.binary(signatures(row, h, t.rows).view(np.uint8).ravel(), np.arange(t.rows + 1) * VALUES * 2).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *map(pa.array, names), packed], ["id", "n", "name", "name2", "sig"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), text).mapInArrow(run, "id bigint, n bigint, name bigint, name2 bigint, sig binary")


def _unpack(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return B.texts(column).data.view(np.uint16).reshape(-1, VALUES)


def keys(classes: DataFrame) -> DataFrame:
    """(key, id): each signature under each chunk with each of its values left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _unpack(batch.column(1)).astype(np.int64).reshape(-1, CHUNKS, WIDTH)
            out = np.empty((len(sig), CHUNKS, WIDTH), np.int64)
            for j in range(WIDTH):
                a, b, c = (sig[:, :, k] for k in range(WIDTH) if k != j)
                out[:, :, j] = (np.arange(CHUNKS) * WIDTH + j) << 48 | a << 32 | b << 16 | c
            yield pa.RecordBatch.from_arrays([pa.array(out.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), VALUES))], ["key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key bigint, id bigint")


def with_distance(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b, …) whose signatures are within NEAR, with the distance."""
    sig, names = classes.select("id", "sig"), pairs.columns
    joined = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select(*pairs.columns, "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = (_unpack(batch.column("sig_a")) != _unpack(batch.column("sig_b"))).sum(1)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(far)], [*names, "far"])
            yield out.filter(pa.array(far <= NEAR))

    return joined.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("far", T.LongType())]))


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, set): the members of the wanted documents' sets as sorted 64-bit numbers in one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "text"):
            t = B.texts(batch.column(1))
            row, h = shingles(t)
            bounds = np.append(0, np.cumsum(np.bincount(row, minlength=t.rows))) * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), B.binary(h.view(np.uint8), bounds).cast(pa.binary())], ["id", "members"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi")
    return chosen.mapInArrow(run, "id bigint, members binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links by their full sets."""
    joined = pairs.select("a", "b").join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a bigint, b bigint")


def _labels(classes: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links)
    return land(classes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("label")), "labels")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, label) of buckets that hold more than one component."""
    now = land(members.select("key", "id").join(labels, "id"), "members")
    mixed = land(now.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key"), "mixed")
    return land(now.join(mixed, "key"), "open")


def _order(sets: DataFrame) -> np.ndarray:
    """How often elements occur, counted in `SLOTS` slots: a table of fixed size by which every set is sorted, rare first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            total += np.bincount(B.texts(batch.column(0)).data.view(np.uint64) % np.uint64(SLOTS), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    got = sets.select("members").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


FILED = ["element", "class", "asks", "id", "label", "ahead", "size", "before"]


def _rest(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that may be links, among documents whose buckets are still open.

    An exact prefix join on the full sets: in one order of all elements, rare ones first, two sets that share at least m
    elements share one among the first |x| - m + 1 of x and the first |y| - m + 1 of y. A set is filed under its first elements
    for partners as long as itself or longer, and asks with its first elements for each class of shorter lengths. Of each
    element's documents, those of its most frequent component are never matched with each other.
    """
    rows = land(left.select("id", "label").distinct().join(sets, "id"), "rest")
    often = _order(rows)
    t = percent / 100
    width = (1 / t) ** (1 / CLASSES)

    def size_class(n: int) -> int:
        return math.floor(math.log(n) / math.log(width) + 1e-9)

    def first_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = tuple([] for _ in FILED)
        held = 0

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], FILED)
            for column in out:
                column.clear()
            return done

        for batch in batches:
            for number, label, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = np.frombuffer(body.as_buffer(), np.uint64)
                n = len(own)
                own = own[np.lexsort((own, often[(own % np.uint64(SLOTS)).astype(np.int64)]))].view(np.int64)
                need = lambda other: math.ceil(t / (1 + t) * (n + other) - 1e-9)  # noqa: B023, E731
                least = math.ceil(t * n - 1e-9)
                spans = [(False, size_class(n), n - need(n) + 1)]
                spans += [(True, c, n - need(max(math.ceil(width**c - 1e-6), least)) + 1) for c in range(size_class(least), size_class(n) + 1)]
                for asks, c, k in spans:
                    k = max(0, min(k, n))
                    for column, value in zip(out, (own[:k], np.full(k, c), np.full(k, asks), np.full(k, number), np.full(k, label), n - np.arange(k), np.full(k, n), np.append(-1 - asks, own[: k - 1])[:k]), strict=True):
                        column.append(value)
                    held += k
                if held > 100_000:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    schema = "element bigint, class bigint, asks boolean, id bigint, label bigint, ahead bigint, size bigint, before bigint"  # ahead: elements from this one on; before: the one ahead of it
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # moved by element once; the steps below find it in place
    filed = rows.select("id", "label", "members").mapInArrow(first_elements, schema).repartition(parts, "element")
    filed = land_by(filed, "filed", "element")
    key = ["element", "class"]
    mixed = filed.groupBy(key).agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("asks").alias("asked"), F.min("asks").alias("given"), F.min("before").alias("from"), F.max("before").alias("to"))
    # no pair comes of an element that stands behind the same one in all its sets, so only the others move on
    mixed = mixed.where("x <> y and asked and not given and from <> to")
    open_keys = land(mixed.select(key), "open-keys").toDF("e", "c")
    filed = land(filed.join(open_keys, (F.col("element") == F.col("e")) & (F.col("class") - F.col("c") == 0), "left_semi"), "open-rows")
    main = land(filed.groupBy(*key, "label").count().groupBy(key).agg(F.max_by("label", F.struct("count", "label")).alias("main")), "main")
    filed = land(filed.join(main, key), "told")
    ask = filed.where("asks").drop("asks")
    give = filed.where("not asks").select(*key, *(F.col(c).alias(f"{c}2") for c in ("id", "label", "main", "ahead", "size", "before")))
    # of shared elements that follow each other in both orders the first one is enough
    enough = (F.col("label") != F.col("label2")) & (F.col("before") != F.col("before2")) & ((100 + percent) * F.least("ahead", "ahead2") >= percent * (F.col("size") + F.col("size2")))
    met = ask.where("label <> main").alias("l").join(give.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in key] + [enough]).select("id", "id2").union(
        ask.where("label = main").alias("l").join(give.where("label2 <> main2").alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in key] + [enough]).select("id", "id2"))
    return met.where("id <> id2").select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """Per row: id, n_shingles (size of its set), component_id (smallest id reachable by links, itself included), kept.

    Null and empty texts have an empty set and stand alone. An id that repeats with other texts stands for
    all of its sets, which it links; of rows that repeat an id, `kept` is true for each whose id is its component's smallest. Other columns are left out. Ids are not null; rows with a null id get a null component and are kept.
    """
    described = land(describe(docs, id_col, text), "described")
    named = land(
        described.where("n > 0 and id is not null").groupBy("n", "name", "name2").agg(F.min(F.struct("id", "sig")).alias("least"), F.count(F.lit(1)).alias("copies"))
        .select("n", "name", "name2", "least.id", "least.sig"), "classes",
    )
    classes = land(named.select("id", "sig"), "signatures")
    filed = keys(classes)
    groups = land(filed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("pivot")).where("size > 1"), "groups")
    members = land(filed.join(groups, "key").select("key", "id", "pivot"), "filed")
    pairs = members.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"), F.col("id").alias("member")).distinct()
    near = land(with_distance(pairs, classes), "near")
    sets = land(sets_of(docs, members.select("id").distinct(), id_col, text), "sets")
    nearest = near.groupBy("member").agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    links = land(confirm(nearest, sets, percent), "links")
    labels = _labels(classes, links)
    left = _open(members, labels)
    if not left.isEmpty():
        links = land(links.union(confirm(_rest(left, sets, percent), sets, percent)), "links")
        labels = _labels(classes, links)
    of_class = named.select("n", "name", "name2", F.col("id").alias("class")).join(labels.toDF("class", "label"), "class")
    of_doc = described.select("id", "n", "name", "name2").join(land(of_class, "of-class"), ["n", "name", "name2"], "left")
    return of_doc.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"),
        F.coalesce(F.coalesce("label", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without all but one row of each group of near-duplicates: the one with the smallest id, null ids last,
    and of rows that repeat it the first by the digest of its text.

    Every row is a document of its own, also where ids repeat or are null. Rows without words all stay. Columns of
    any name are carried along.
    """
    rows = keyed(docs, id_col, text)
    kept = land(near_duplicates(rows, "key", "text").where("kept").select("key"), "kept")
    return unpacked(rows.join(kept, "key", "left_semi"), docs.columns, text=text)
