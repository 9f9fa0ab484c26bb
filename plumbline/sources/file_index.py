"""Which files of an archive hold which symbols, so that a read for some symbols opens only their files.

Layout: `<index>/files` lists the files read so far (path, length, modified), `<index>/postings` the (symbol, file) pairs in folders
by hash of the symbol. Both are small beside the archive: a posting per symbol and file, whatever rows lie behind it. A file
counts as known only in the very state it was read in; new and changed files are always opened, so a late index costs time,
never rows. Postings are exact: unlike ranges or filters per file, they are found by an equi-join and name no file in vain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.readers import FILING_PAYLOAD, filing_archive, filing_payloads, with_company

BUCKETS = 64
STATE = ["path", "length", "modified"]
FILES = "path string, length bigint, modified timestamp"
SHARD = T.StructType([*FILING_PAYLOAD.fields, T.StructField("filing_to", T.StringType())])


def file_state(rows: DataFrame) -> list:
    meta = rows["_metadata"]
    return [meta["file_path"].alias("path"), meta["file_size"].alias("length"), meta["file_modification_time"].alias("modified")]


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder as they are now; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(*file_state(files))


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def unknown_files(spark: SparkSession, folder: str, index: str) -> DataFrame:
    return listed(spark, folder).join(stored(spark, f"{index}/files", FILES), STATE, "left_anti")


def paths_of(files: DataFrame) -> list[str]:
    """Paths of files to open: the list a reader is given, as long as the files it opens."""
    return [row["path"] for row in files.select("path").distinct().collect()]


def read_shards(spark: SparkSession, folder: str, paths: list[str]) -> DataFrame:
    """Shards of these files, with the state of the file each comes from; `filing_to` is the name of the folder."""
    if not paths:
        fields = [*SHARD.fields, *(T.StructField(n, t) for n, t in zip(STATE, (T.StringType(), T.LongType(), T.TimestampType())))]
        return spark.createDataFrame([], T.StructType(fields))
    rows = spark.read.schema(SHARD).option("basePath", folder).json(paths)
    return rows.select("*", *file_state(rows))


def update_index(spark: SparkSession, folder: str, index: str, recent: DataFrame) -> int:
    """Read the files the index does not know and add them; returns their number. Shards without symbol get it from `recent`.

    Postings are written before the files are listed as known, so a crash in between leaves files that are read again.
    """
    new = unknown_files(spark, folder, index)
    paths = paths_of(new)
    if not paths:
        return 0
    shards = read_shards(spark, folder, paths).withColumn("file", F.struct(*STATE))
    rows = with_company(shards, recent).where("symbol IS NOT NULL").select("symbol", "file.*").distinct().persist()
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS)).cast("int"))
    placed.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{index}/postings")
    # the state the rows were read in; a file without rows is known by its listing
    seen = placed.select(*STATE).unionByName(new.join(placed.select("path"), "path", "left_anti").select(*STATE)).distinct()
    seen.coalesce(1).write.mode("append").parquet(f"{index}/files")
    rows.unpersist()
    return len(paths)


def files_of(spark: SparkSession, folder: str, index: str, wanted: DataFrame) -> DataFrame:
    """Files that hold a wanted symbol or are not known in their present state."""
    keys = wanted.select("symbol").where("symbol IS NOT NULL").distinct().withColumn("bucket", F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS)).cast("int"))
    folders = [row["bucket"] for row in keys.select("bucket").distinct().collect()]  # at most BUCKETS
    postings = stored(spark, f"{index}/postings", f"symbol string, {FILES}, bucket int").where(F.col("bucket").isin(folders))
    hits = postings.join(keys, ["bucket", "symbol"], "left_semi").select(*STATE)
    return listed(spark, folder).join(hits, STATE, "left_semi").unionByName(unknown_files(spark, folder, index))


def read_archive_of(spark: SparkSession, recent_path: str, archive_path: str, index: str, wanted: DataFrame, start) -> DataFrame:
    """`read_filing_archive` for the wanted symbols, opening only the archive files that may hold them."""
    keys = wanted.select("symbol").distinct()
    recent = filing_payloads(spark, recent_path)
    shards = read_shards(spark, archive_path, paths_of(files_of(spark, archive_path, index, keys))).drop("length", "modified")
    mine = with_company(shards, recent).join(keys, "symbol", "left_semi")
    return filing_archive(recent.join(keys, "symbol", "left_semi"), mine, start)
