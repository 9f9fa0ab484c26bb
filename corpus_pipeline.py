"""The corpus pipeline: stages over `documents`, each written as Parquet and reread by the next.

1. toxicity: documents that the classifier scores at 0.7 or more go; it learns from the labels of the documents given.
2. near_duplicates: of each group of near-duplicates the document with the smallest id stays, null ids last.
3. repeats: bytes of strings of 100 bytes that stand earlier are cut out of the texts; a document cut to nothing stays, empty.
4. leaks: documents that hold a passage of the benchmark go.
5. tokens: texts become ids and what the ids decode to; this stage adds the column `ids`, or `ids_2` and so on where a column
   has that name.

Null and empty texts pass through every stage. Columns beyond those of `documents` are carried along, whatever their names. Every
row is a document of its own: rows that repeat an id or have none are judged one by one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, near_dedup, pieces, suffix_dedup, toxicity
from plumbline.llm.queries import held_out, importable
from plumbline.llm.rows import free_name, keyed, packed, unpacked
from plumbline.llm.store import land

ORACLE_SQL = None
TOXIC = 0.7


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    importable(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels, ~held_out())
    return unpacked(toxicity.score(packed(docs), model).where(F.col("score") < TOXIC), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    importable(spark)
    return near_dedup.representatives(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what stands earlier; n_chars follows the text."""
    importable(spark)
    return suffix_dedup.shortened(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    importable(spark)
    rows = keyed(docs)
    found = decontaminate.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    return unpacked(rows.join(land(found.select("key").distinct(), "leaked"), "key", "left_anti"), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text; the text becomes what the ids decode to."""
    importable(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    done = pieces.decode(pieces.encode(packed(docs), model), model, text="text")
    return unpacked(done, docs.columns, F.col("ids").alias(free_name("ids", docs.columns)))


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("repeats", repeats), ("leaks", leaks), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
