"""Ticker directory: ranked search, merged results and registration defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators.matching import top_n_per_key

# Fixed value: the one nickname the search knows.
NICKNAMES = {"aws": "amzn"}


def match_rank(needle: Column, symbol: Column, name: Column) -> Column:
    """0 exact symbol, 1 exact name, 2 symbol prefix, 3 name prefix, 4 contained; null when there is no match."""
    symbol, name = F.lower(symbol), F.lower(name)
    return (
        F.when(symbol == needle, 0).when(name == needle, 1).when(F.startswith(symbol, needle), 2)
        .when(F.startswith(name, needle), 3).when(F.contains(symbol, needle) | F.contains(name, needle), 4)
    )


def normal_needle(text: str) -> str:
    needle = text.strip().lower()
    return NICKNAMES.get(needle, needle)


def search_catalog(catalog: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Best matches by rank, then name length, then symbol; a distributed top-k, nothing else is kept."""
    rank = match_rank(F.lit(normal_needle(text)), F.col("symbol"), F.col("name"))
    return (
        catalog.withColumn("rank", rank).where("rank IS NOT NULL")
        .orderBy("rank", F.length("name"), "symbol").limit(limit)
    )


def search_many(catalog: DataFrame, texts: list[str], limit: int = 8) -> DataFrame:
    """The same search for several texts in one pass: each row emits only the needles it matches."""
    needles = F.array(*[F.lit(normal_needle(t)) for t in texts])
    hits = F.filter(
        F.transform(needles, lambda n: F.struct(n.alias("needle"), match_rank(n, F.col("symbol"), F.col("name")).alias("rank"))),
        lambda h: h["rank"].isNotNull(),
    )
    rows = catalog.select("symbol", "name", F.explode(hits).alias("hit")).select("symbol", "name", "hit.needle", "hit.rank")
    best = top_hits(rows, limit)
    return best.select("needle", "symbol", "name", "rank", F.col("_rank").alias("position"))


def top_hits(rows: DataFrame, limit: int) -> DataFrame:
    return top_n_per_key(rows, ["needle"], ["rank", F.length("name"), "symbol"], limit)


def local_matches(catalog: DataFrame, text: str) -> DataFrame:
    """Rows whose symbol, name, short name or any alias contains the text; a blank text keeps everything."""
    needle = text.strip().lower()
    if not needle:
        return catalog

    def holds(value: Column) -> Column:
        return F.contains(F.lower(value), F.lit(needle))

    return catalog.where(
        holds(F.col("symbol")) | holds(F.col("name")) | holds(S.short_name(F.col("name"))) | F.exists("aliases", holds))


def merged_results(local: DataFrame, remote: DataFrame, limit: int = 8) -> DataFrame:
    """Local results first, then remote ones not already listed, cut at `limit`."""
    extra = remote.join(local.select("symbol"), "symbol", "left_anti").withColumn("origin", F.lit(1))
    both = local.withColumn("origin", F.lit(0)).select("origin", "symbol", "name").unionByName(extra.select("origin", "symbol", "name"))
    return both.orderBy("origin", "symbol").limit(limit)


def register(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requested companies with name, cik and exchange from the request, else the catalogue, else defaults."""
    known = catalog.select(F.col("symbol").alias("_s"), F.col("name").alias("_name"), F.col("cik").alias("_cik"), F.col("exchange").alias("_exchange"))
    rows = requests.withColumn("symbol", S.valid_symbol(F.col("symbol"))).where("symbol IS NOT NULL")
    return rows.join(known, F.col("symbol") == F.col("_s"), "left").select(
        "symbol", F.coalesce("name", "_name", "symbol").alias("name"), F.coalesce("cik", "_cik").alias("cik"),
        F.coalesce("exchange", "_exchange", F.lit("US")).alias("exchange"))
