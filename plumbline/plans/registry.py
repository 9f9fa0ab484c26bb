"""Registration of runnable queries: a name, the inventory entries it covers, the DataFrame and its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.sql_views import complete

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def publish(df: DataFrame) -> DataFrame:
    """Days and timestamps as ISO text, so every reader sees the same values."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = column.cast("string").alias(field.name)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        columns.append(column)
    return df.select(*columns)


def run(build: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days are UTC days whatever the session's zone was."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return publish(build(spark, sf_dir))


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: run(build, spark, sf_dir)
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            CHECKS[name] = complete(sql)
        return build

    return register
