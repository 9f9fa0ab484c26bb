"""Session helpers: configuration for local runs and the shared working folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "plumbline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the package relies on (UTC, AQE); size settings stay with the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under `spark.checkpoint.dir`; where none is set, under the warehouse, which executors share as well."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(root or spark.conf.get('spark.sql.warehouse.dir') + '/shared').rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_landed: dict[tuple[str, str, str, str], str] = {}


def input_identity(spark: SparkSession, scope: str) -> str:
    """Changes when a file under the folder is added, replaced or removed; only the listing is read, no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(scope)
    mark = F.sum(F.xxhash64("path", "length", F.unix_micros("modificationTime")).cast("decimal(38,0)"))
    return str(tuple(files.agg(F.count(F.lit(1)), mark).first()))


def input_tasks(spark: SparkSession, scope: str, bytes_each: int = 16 << 20) -> int:
    """A number of tasks in proportion to the files under the folder: one for each 16 MB, and no fewer than the session's own
    parallelism. Steps that sort or hash all rows are dealt by it, so that what one task holds does not grow with the input."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(scope)
    held = files.agg(F.sum("length")).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, -(-held // bytes_each))


def landed(
    spark: SparkSession, scope: str, name: str, build: Callable[[], DataFrame], partition_by: tuple[str, ...] = (),
) -> DataFrame:
    """A table written once per application and state of its input folder, and read back: short lineage for all that use it.

    The copies lie under `shared_folder`; `drop_landed` deletes them.
    """
    key = (spark.sparkContext.applicationId, scope, name, input_identity(spark, scope))
    if key not in _landed:
        path = shared_folder(spark, name)
        build().write.partitionBy(*partition_by).parquet(path)
        _landed[key] = path
    return spark.read.parquet(_landed[key])


def drop_landed(spark: SparkSession) -> None:
    """Delete what this application has landed."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for key in [k for k in _landed if k[0] == spark.sparkContext.applicationId]:
        path = hadoop(_landed.pop(key))
        path.getFileSystem(conf).delete(path, True)
