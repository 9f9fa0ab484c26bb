"""An index of the ticker directory for many searches at once: postings of short character grams, the rarest looked up first.

Symbols and names are cut into grams of one to three characters, in lower case. A text that contains a needle contains every
gram of it, so the entries under the needle's rarest gram are all that can match; they are then judged by the very rule of the
scan. Needles and postings meet in an equi-join, so a thousand needles cost one pass over the postings they name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.directory import NICKNAMES, match_rank, top_hits

LONGEST = 3
BUCKETS = 64
PARTS = 16


def grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct grams of these lengths; none of a null or shorter text."""

    def of(size: int) -> Column:
        last = F.length(text) - size + 1
        places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda place: F.substring(text, place, F.lit(size)))

    cut = [of(size) for size in sizes]
    return F.array_distinct(F.coalesce(F.concat(*cut), F.array().cast("array<string>")))


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_index(catalog: DataFrame, path: str, tasks: int | None = None) -> None:
    """Postings (gram, part, symbol) in folders by hash of the gram, and beside them how many entries each gram has.

    One gram may stand in nearly every name, so its postings are cut into parts by symbol. An entry becomes some eighty postings:
    `tasks`, given by a caller that knows the size of the directory, deals the entries before they are cut up, by symbol, so that
    repeated ones meet without a shuffle of the postings.
    """
    every = tuple(range(1, LONGEST + 1))
    texts = F.array_distinct(F.concat(grams(F.lower("symbol"), every), grams(F.lower("name"), every)))
    entries = catalog.select("symbol", "name")
    entries = entries.repartition(tasks, "symbol") if tasks else entries
    postings = entries.select("symbol", F.explode(texts).alias("gram")).distinct()
    postings = postings.withColumns({"bucket": bucket(F.col("gram")), "part": F.pmod(F.xxhash64("symbol"), F.lit(PARTS)).cast("int")})
    dealt = postings.repartition(tasks, "bucket", "part") if tasks else postings.repartition("bucket", "part")
    dealt.sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = catalog.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("bucket", "gram").count().repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")


def needles(texts: DataFrame, column: str = "text") -> DataFrame:
    """Distinct needles as the scan reads them: white space around them cut, lower case, nicknames resolved. Blank ones go."""
    plain = F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    known = F.create_map(*[F.lit(part) for pair in NICKNAMES.items() for part in pair])
    return texts.select(F.coalesce(known[plain], plain).alias("needle")).where("needle <> ''").distinct()


def rarest_grams(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(needle, gram, entries) of each needle's rarest gram; a needle with a gram that no entry has can match nothing and goes."""
    size = F.least(F.length("needle"), F.lit(LONGEST))
    cut = F.when(size == LONGEST, grams(F.col("needle"), (LONGEST,))).otherwise(F.array("needle"))
    pieces = wanted.select("needle", F.size(cut).alias("_all"), F.explode(cut).alias("gram")).withColumn("bucket", bucket(F.col("gram")))
    counted = pieces.join(spark.read.parquet(f"{path}/counts"), ["bucket", "gram"])
    best = counted.groupBy("needle", "_all").agg(F.count(F.lit(1)).alias("_found"), F.min(F.struct("count", "gram")).alias("best"))
    return best.where("_found = _all").select("needle", F.col("best.gram").alias("gram"), F.col("best.count").alias("entries"))


def candidates(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(needle, symbol) under each needle's rarest gram. Only the folders of these grams are read; at most BUCKETS numbers reach the driver."""
    rare = rarest_grams(spark, path, wanted).withColumn("bucket", bucket(F.col("gram")))
    folders = [row["bucket"] for row in rare.select("bucket").distinct().collect()]
    postings = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(folders))
    spread = rare.withColumn("part", F.explode(F.array(*[F.lit(part) for part in range(PARTS)])))
    return postings.join(spread, ["bucket", "gram", "part"]).select("needle", "symbol")


def search_indexed(catalog: DataFrame, path: str, texts: DataFrame, column: str = "text", limit: int = 8) -> DataFrame:
    """Best matches (needle, symbol, name, rank, position) of every text, equal to the scan's.

    The index says which symbols to look at; rows of the catalogue are judged as they are now, so an index may hold entries
    that are gone, but a new entry is found only once it is indexed. Entries without symbol are found by name.
    """
    found = candidates(catalog.sparkSession, path, needles(texts, column)).withColumnRenamed("symbol", "_symbol")
    rows = catalog.select("symbol", "name").join(found, F.col("symbol").eqNullSafe(F.col("_symbol")))
    judged = rows.select("needle", "symbol", "name", match_rank(F.col("needle"), F.col("symbol"), F.col("name")).alias("rank")).where("rank IS NOT NULL")
    return top_hits(judged, limit).select("needle", "symbol", "name", "rank", F.col("_rank").alias("position"))
