"""Line dedup: lines that stand in many documents are dropped, except in the last document that holds them.

Texts are split at line feeds. A line's key is the line without spaces at both ends, A-Z lower-cased; only keys of at least
`least_length` code points count. The keys of all documents are exploded as 128-bit hashes, and each hash's distinct documents
are counted, in two steps of an aggregate, so a line that stands in a third of all documents is summed up by every task before
it moves. The repeated keys, a small table of its own, are joined back to the places of the lines; only places to drop reach
the documents, where the text is put together again from the runs of lines between them.

Everything is a native expression. The one exchange that a hot key could fill, that of the places, has plain exchanges on both
sides, so adaptive execution splits the key's rows over many tasks.

Two keys count as one if two 64-bit hashes of both agree, by chance about once in 1e38 pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import land
from plumbline.llm.url_filters import LOWER, UPPER

SPACES = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keys_of(text: Column) -> Column:
    """The lines' keys in order."""
    return F.transform(lines_of(F.translate(text, UPPER, LOWER)), lambda line: F.btrim(line, F.lit(SPACES)))


def digest(*values: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(F.lit(seed), *values) for seed in (1, 2)]


def places(docs: DataFrame, least_length: int) -> DataFrame:
    """One row per line that counts: document, digest of its text, place from 0, digest of the key."""
    keyed = docs.select("doc", "t1", "t2", F.posexplode(keys_of(F.col("text"))).alias("place", "key")).where(F.length("key") >= least_length)
    return keyed.select("doc", "t1", "t2", "place", *(h.alias(f"k{i}") for i, h in enumerate(digest(F.col("key")), 1)))


def repeated(lines: DataFrame, least_docs: int) -> DataFrame:
    """Keys found in at least `least_docs` documents, with the last of these. A null id is one document, before all others."""
    doc = F.struct(F.col("doc").isNotNull().alias("known"), F.col("doc").alias("id"))
    found = lines.groupBy("k1", "k2").agg(F.count_distinct(doc).alias("n_docs"), F.max(doc).alias("last"))
    return found.where(F.col("n_docs") >= least_docs).select("k1", "k2", "n_docs", F.col("last.id").alias("last"))


def without_repeated_lines(
    docs: DataFrame, least_length: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: id, text, `kept` (the lines that stay, joined by line feeds), `n_lines`, `n_dropped`,
    `dropped` (places of the dropped lines, ascending from 0).

    A document is an id: rows with one id count as one document, null ids too. Repeated rows come back as often as they came
    with equal results; of two texts with the last id both keep the line. Other columns are left out, so no name can clash.
    """
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    docs = docs.select("*", *(h.alias(f"t{i}") for i, h in enumerate(digest(F.coalesce("text", F.lit("")), F.col("text").isNull()), 1)))
    lines = places(docs, least_length)
    often = land(repeated(lines, least_docs), "lines")
    gone = (
        lines.join(often, ["k1", "k2"]).where(~F.col("doc").eqNullSafe(F.col("last")))
        .groupBy("doc", "t1", "t2").agg(F.array_sort(F.collect_set("place")).alias("dropped"))
        .select(F.col("doc").alias("_doc"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "dropped")
    )
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    dropped = F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")
    joined = docs.join(gone, same, "left").select("doc", "text", dropped, lines_of(F.col("text")).alias("lines"))

    # the runs of lines between dropped places, each a slice
    n = F.size("lines")
    borders = F.concat(F.array(F.lit(-1)), F.col("dropped"), F.array(n))
    joined = joined.withColumn("borders", borders)
    runs = F.transform(F.sequence(F.lit(1), F.size("dropped") + 1), lambda i: F.struct(
        (F.get("borders", i - 1) + 2).alias("at"), (F.get("borders", i) - F.get("borders", i - 1) - 1).alias("size"),
    ))
    joined = joined.withColumn("runs", runs)
    stay = F.flatten(F.transform("runs", lambda r: F.slice("lines", r["at"], r["size"])))
    kept = F.when(F.size("dropped") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(stay, "\n"))
    return joined.select(
        F.col("doc").alias(id_col), F.col("text").alias(text_col), kept.alias("kept"), n.cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"), "dropped",
    )
