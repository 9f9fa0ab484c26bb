"""Rows under a key of their own, with their columns packed where names that operators add cannot meet them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import land


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(name: str, taken: list[str]) -> str:
    """The name, or with the first number from 2 on that no column has; names that differ in case only are the same."""
    used = {c.lower() for c in taken}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(2, len(used) + 3))) if n.lower() not in used)


def packed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, text): the columns but the text in one struct, the id and the text."""
    return docs.select(F.struct(*(quoted(c) for c in docs.columns if c != text)).alias("row"), quoted(id_col).alias("doc_id"), quoted(text).alias("text"))


def unpacked(rows: DataFrame, columns: list[str], *more: Column, text: str = "text") -> DataFrame:
    """The columns of a packed table as they were, with the text as it is now."""
    return rows.select(*(F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns), *more)


def keyed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, text): packed rows, each with a bigint key that no other row has; smaller ids have smaller keys.

    The key is the id where no id is null or repeats. Otherwise rows are numbered in the order of id (null ids last), digest of the
    text and digest of the other columns, and written once, so that every later step sees the same numbers. The sort
    splits an id that many rows share.
    """
    rows, own = packed(docs, id_col, text), F.col("doc_id").cast("bigint")
    odd = rows.groupBy(own.alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null")
    if odd.isEmpty():
        return rows.select("row", own.alias("key"), "text")
    order = [own.asc_nulls_last(), F.sha2(F.col("text").cast("binary"), 256).asc_nulls_first(), F.xxhash64(F.to_json("row"))]
    return land(rows.orderBy(*order).select("row", F.monotonically_increasing_id().alias("key"), "text"), "numbered")
