"""Time-aware joins built from unions, windows and bucketed equi-joins: no inequality join, no pair blow-up."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import shared_folder


def asof_backward(
    left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str,
    payload: list[str], bucket: str | None = None, tasks: int | None = None,
) -> DataFrame:
    """Each left row with the latest right row at or before its time; `event` is null when there is none.

    Both sides are tagged and unioned, and one window carries the last event forward: linear, one shuffle. A whole
    struct is carried, so an event with a null value still replaces the one before it. Right rows must be unique per
    key and time. Without `bucket` a key is one window group, right for daily series (a key has at most one row per
    day on each side). With `bucket` (a `date_trunc` unit) groups are cut by time, so a key of any size is spread over
    many tasks; the last event of earlier buckets comes from a small table of bucket summaries. `tasks` is the number of
    tasks the keys are dealt to without `bucket`; Spark chooses where none is given.
    """
    event = F.struct(*payload)
    left_columns = left.columns
    rows = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_row"))
    events = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), event.alias("_event"))
    both = rows.unionByName(events, allowMissingColumns=True)
    if bucket is None:
        both = dealt(both, tasks, *by)
        window = W.partitionBy(*by).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
        return (
            both.withColumn("event", F.last("_event", ignorenulls=True).over(window))
            .where("_side = 1").select(*[f"_row.{c}" for c in left_columns], "event")
        )
    both = both.withColumn("_bucket", F.date_trunc(bucket, "_t"))
    window = W.partitionBy(*by, "_bucket").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = both.withColumn("_local", F.last("_event", ignorenulls=True).over(window)).where("_side = 1")
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        both.groupBy(*by, "_bucket").agg(F.max_by("_event", F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    )
    return (
        local.join(carry, [*by, "_bucket"], "left")
        .select(*[f"_row.{c}" for c in left_columns], F.coalesce("_local", "_carry").alias("event"))
    )


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """The rows dealt to `tasks` tasks by their keys; where no number is given, Spark deals them as the next step needs."""
    return df.repartition(tasks, *keys) if tasks else df


def multiset_difference(left: DataFrame, right: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows that one side holds more often than the other, once for each time, with `in_left`; nulls equal nulls.

    Both sides are counted together, so each is read and moved once.
    """
    columns = left.columns
    both = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    rest = dealt(both, tasks, *columns).groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    times = F.array_repeat(F.col("_n") > 0, F.abs("_n").cast("int"))
    return rest.select(*columns, F.explode(times).alias("in_left"))


def band_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, low: int, high: int,
) -> DataFrame:
    """Inner join on `keys` where `right_day - left_day` lies in `[low, high]` days.

    Days are cut into buckets as wide as the band, so a left row probes at most two buckets and the join is an
    equi-join; only near rows ever meet.
    """
    width = high - low + 1
    epoch = F.lit("1970-01-01").cast("date")

    def slot(day):
        return F.floor(day / F.lit(width))

    day = F.datediff(F.col(left_day), epoch)
    probes = F.array_distinct(F.array(slot(day + low), slot(day + high)))
    probe = left.withColumn("_slot", F.explode(probes))
    build = right.withColumn("_slot", slot(F.datediff(F.col(right_day), epoch)))
    if set(left.columns) & set(right.columns) - set(keys):
        raise ValueError("band_join needs distinct column names outside the keys")
    return probe.join(build, [*keys, "_slot"]).where(
        F.datediff(F.col(right_day), F.col(left_day)).between(low, high)
    ).drop("_slot")


def lookup_join(df: DataFrame, vocabulary: DataFrame, keys: list[str], deal_by: list[str], shares: int = 64) -> DataFrame:
    """Inner join with a small table on few distinct keys, each of which may hold a large part of the rows.

    The table is listed once per share and a row looks in the share its `deal_by` columns fall into: where Spark does not
    broadcast the table, the rows of one key are dealt to many tasks instead of one.
    """
    listed = vocabulary.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    share = F.pmod(F.xxhash64(*deal_by), F.lit(shares)).cast("int")
    return df.withColumn("_share", share).join(listed, [*keys, "_share"]).drop("_share")


def keep_latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key, the greatest by `order`; an aggregate, so each task reduces its rows before the shuffle."""
    return (
        df.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")
    )


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return (
        df.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")
    )


def top_n_per_key(df: DataFrame, keys: list[str], order: list, n: int, salts: int = 32) -> DataFrame:
    """The first `n` rows of each key by `order`, with `_rank`.

    A first pass keeps `n` rows per key and salt, so a key that holds most rows is cut down by many tasks before the
    second pass ranks what is left. Both passes are exact.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    first = W.partitionBy(*keys, "_salt").orderBy(*order)
    final = W.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(final)).where(F.col("_rank") <= n).drop("_salt")
    )


def global_rank(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Every row with its place in one order over all rows, without one window over all of them.

    The rows are cut into ranges, written once so that the cuts stay the same, numbered inside each, and moved on by the
    sizes of the ranges before, a table of one row per range.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "ranked")
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(path)
    sizes = placed.groupBy("_range").count()
    before = sizes.withColumn("_before", F.sum("count").over(W.orderBy("_range")) - F.col("count")).drop("count")
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return placed.withColumn("_row", inside).join(before, "_range").withColumn(name, (F.col("_row") + F.col("_before")).cast("long")).drop("_row", "_before", "_range")


def order_statistics(df: DataFrame, keys: list[str], value: str, percentiles: tuple[int, ...]) -> DataFrame:
    """Exact quantiles, linear between ranks, of groups of any size: keys, percentile, `value`. Nulls and NaN take no part.

    Equal values of a group become one row with their number before anything is ordered. These rows are cut into ranges of one
    order (keys, value), written once so that the cuts stay the same; running counts inside a range and the counts of the ranges
    before give each row the ranks it holds in its group. Only rows that hold a wanted rank go on: no group is gathered, and a
    group or a value that holds a third of all rows is spread like any other.
    """
    spark = df.sparkSession
    number = F.col(value).cast("double")
    counted = df.where(number.isNotNull() & ~F.isnan(number)).groupBy(*keys, number.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    path = shared_folder(spark, "counted")
    counted.repartitionByRange(*keys, "_v").withColumn("_range", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.schema(T.StructType([*counted.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(path)
    inside = W.partitionBy("_range", *keys).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    # one row per group and range: groups lie in neighbouring ranges
    parts = placed.groupBy("_range", *keys).agg(F.sum("_n").alias("_part"))
    whole = W.partitionBy(*keys)
    before = F.sum("_part").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_part")
    parts = parts.select("_range", *(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), before.alias("_before"), F.sum("_part").over(whole).alias("_all"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)), placed["_range"] == parts["_range"])
    rows = placed.withColumn("_upto", F.sum("_n").over(inside)).join(parts, same).select(*keys, "_v", "_n", "_all", (F.col("_upto") + F.col("_before")).alias("_upto"))
    wanted = F.array(*[F.lit(p) for p in percentiles])

    def rank(p):
        return (F.col("_all") - 1) * p / F.lit(100.0)

    def holds(position):
        return (position < F.col("_upto")) & (position >= F.col("_upto") - F.col("_n"))

    held = F.filter(wanted, lambda p: holds(F.floor(rank(p))) | holds(F.ceil(rank(p))))
    found = rows.select(*keys, "_v", "_n", "_upto", "_all", F.explode(held).alias("percentile"))
    position = rank(F.col("percentile"))
    low, high = F.floor(position), F.ceil(position)
    ends = found.groupBy(*keys, "percentile").agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_low"), F.max(F.when(holds(high), F.col("_v"))).alias("_high"), F.max(position - low).alias("_part"))
    return ends.select(*keys, "percentile", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias(value))
