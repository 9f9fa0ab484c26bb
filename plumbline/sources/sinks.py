"""Sinks. The merges are DataFrame functions; `versions.Table` keeps keyed tables with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.matching import keep_latest

def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert or replace by key: the greatest `order` wins, incoming over existing on a tie."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_latest(both, keys, *order, "_new").drop("_new")


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The incoming rows to append: keys not stored yet, the first of each key."""
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")
    return first.join(existing.select(*keys), keys, "left_anti")


def run_log(outcomes: DataFrame, detail_length: int | None = None) -> DataFrame:
    """Log rows (source, status, detail, created_at); the detail is cut only where a length is given."""
    detail = F.col("detail") if detail_length is None else F.substring("detail", 1, detail_length)
    return outcomes.select("source", "status", detail.alias("detail"), "created_at")


def write_run_log(df: DataFrame, path: str, detail_length: int | None = None) -> None:
    run_log(df, detail_length).write.mode("append").parquet(path)


def nested_results(summary: DataFrame, windows: DataFrame) -> DataFrame:
    """One JSON text per symbol with its summary and its (at most four) coverage windows."""
    details = [c for c in windows.columns if c != "symbol"]
    nested = windows.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(*details))).alias("coverage"))
    fields = [c for c in summary.columns if c != "symbol"]
    return summary.join(nested, "symbol", "left").select(
        "symbol", F.to_json(F.struct(F.struct(*fields).alias("valuation"), "coverage")).alias("payload"))


def export_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def detail_text(updated: Column, failed: Column) -> Column:
    return F.concat(F.lit("updated "), updated.cast("string"), F.lit("; failed "), failed.cast("string"))
