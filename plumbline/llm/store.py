"""Tables that several steps read, written once to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from plumbline.session import shared_folder


def land(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet under `spark.checkpoint.dir` and read back: short lineage, no second run of its plan."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def land_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """The same as a table in the warehouse, bucketed by a key it is already partitioned by: later joins on the key do not move it."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)
