"""Reconciliation of two dated tables by trees of digests: only where digests differ are rows compared.

A table's tree has a node per symbol, per year and per month of it. A node's digest is the number of its rows and two sums of
row hashes, so it does not depend on their order, counts repeated rows, and a parent's digest is the sum of its children's. Two
trees are compared from the symbols down; children are looked at only below nodes that differ. Rows move only from months that
differ, so an audit of two tables that mostly agree shuffles digests (one row per symbol and month and task) and little else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.audit import TOLERANCE, reconcile_samples
from plumbline.session import shared_folder

LEVELS = (("symbol", ["symbol"]), ("year", ["symbol", "year"]), ("month", ["symbol", "year", "month"]))
SAMPLE = ("price", "pe", "eps", "eps_filed_at", "eps_period_end")


def with_period(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"year": F.year("date"), "month": F.month("date")})


def row_hash(columns: list[str], seed: int) -> Column:
    """A hash of the columns and of which of them are null, since the hash function passes nulls over."""
    return F.xxhash64(F.lit(seed), *columns, *[F.col(c).isNull() for c in columns]).cast("decimal(38,0)")


def digest_tree(rows: DataFrame, values: tuple[str, ...] = SAMPLE) -> DataFrame:
    """(level, symbol, year, month, n, h1, h2) of rows (symbol, date, values); to be written beside the table it describes.

    The month's nodes are one aggregate with partial sums in each task; upper levels sum these few rows up. Rows without
    symbol or date have no place in the tree.
    """
    columns = ["symbol", "date", *values]
    placed = with_period(rows.where("symbol IS NOT NULL AND date IS NOT NULL"))
    months = placed.groupBy("symbol", "year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.sum(row_hash(columns, 1)).alias("h1"), F.sum(row_hash(columns, 2)).alias("h2"))
    ups = F.array(*[F.struct(F.lit(level).alias("level"), *[(F.col(k) if k in keys else F.lit(None).cast("int")).alias(k) for k in ("year", "month")]) for level, keys in LEVELS])
    nodes = months.select("symbol", F.explode(ups).alias("up"), "n", "h1", "h2")
    return nodes.groupBy("up.level", "symbol", "up.year", "up.month").agg(F.sum("n").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))


def write_tree(rows: DataFrame, path: str, values: tuple[str, ...] = SAMPLE) -> None:
    """The tree in folders by level, so that a comparison reads a level only when it gets there."""
    digest_tree(rows, values).write.mode("overwrite").partitionBy("level").parquet(path)


def compared_nodes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(level, symbol, year, month, differs) of all nodes that the descent looks at: a level's nodes below differing parents."""
    seen, parents = None, None
    for level, keys in LEVELS:
        def side(tree: DataFrame, name: str) -> DataFrame:
            nodes = tree.where(F.col("level") == level).select(*keys, F.struct("n", "h1", "h2").alias(name))
            return nodes if parents is None else nodes.join(parents, keys[:-1], "left_semi")

        nodes = side(left, "_a").join(side(right, "_b"), keys, "full").select(*keys, (~F.col("_a").eqNullSafe(F.col("_b"))).alias("differs"))
        parents = nodes.where("differs").select(*keys)
        here = nodes.select(F.lit(level).alias("level"), "symbol", *[(F.col(k) if k in keys else F.lit(None).cast("int")).alias(k) for k in ("year", "month")], "differs")
        seen = here if seen is None else seen.unionByName(here)
    return seen


def differing_months(left: DataFrame, right: DataFrame) -> DataFrame:
    """(symbol, year, month) whose rows differ between the tables of two trees.

    Written once and read back: its size is then known, and Spark broadcasts it to the rows only below its own limit.
    """
    spark = left.sparkSession
    path = shared_folder(spark, "differing")
    compared_nodes(left, right).where("level = 'month' AND differs").select("symbol", "year", "month").write.parquet(path)
    return spark.read.schema("symbol string, year int, month int").parquet(path)


def suspects(rows: DataFrame, months: DataFrame) -> DataFrame:
    """The rows of these months, and all rows without symbol or date, which no tree covers; one pass over the rows."""
    marked = with_period(rows).join(months.withColumn("_in", F.lit(True)), ["symbol", "year", "month"], "left")
    return marked.where("_in OR symbol IS NULL OR date IS NULL").select(*rows.columns)


def reconcile_by_digests(
    published: DataFrame, rebuilt: DataFrame, published_tree: DataFrame | None = None, rebuilt_tree: DataFrame | None = None, tolerance: float = TOLERANCE,
) -> DataFrame:
    """The differences that `reconcile_samples` finds, comparing only the months whose digests differ.

    Trees that were stored with the tables are used where given. Digests are exact: a month that differs within the tolerance
    only is compared and yields nothing. Equal digests of different months would hide them; that takes equal row counts and two
    equal sums of 64-bit hashes.
    """
    rebuilt = rebuilt.where("pe IS NOT NULL")
    columns = ["symbol", "date", *SAMPLE]
    published, rebuilt = published.select(*columns), rebuilt.select(*columns)
    trees = [digest_tree(rows) if tree is None else tree for rows, tree in ((published, published_tree), (rebuilt, rebuilt_tree))]
    months = differing_months(*trees)
    return reconcile_samples(suspects(published, months), suspects(rebuilt, months), tolerance)
