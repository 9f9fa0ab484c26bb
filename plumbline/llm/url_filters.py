"""URL filters: rules of host and path prefix, found by an equi-join on short digests.

A rule fits a url if its host is the url's host or a parent domain of it and the url's path begins with the rule's path. Each
url is expanded into host suffixes (at label borders) times path prefixes (at slashes); each rule is filed under its host and
its path up to the last slash. Both sides are joined on the first 32 bits of the SHA-256 of that expression; the full digest
and the rest of the path are confirmed on the joined rows. No expression is deeper than the deepest rule, so the expansion of
a very long url stays small. Of the rules that fit, the longest (host and path together) wins, then the one with the longer
host, then `block` before `allow`.

The side of the rules is broadcast only where Spark finds it under its size limit; beyond that it is a sort-merge join, in
which adaptive execution splits hot expressions (`com/` and the like).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def filed(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with the digest they are filed under. Null or empty hosts and null verdicts drop out; a null path is `/`."""
    rules = rules.where("host <> '' and verdict is not null").select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("/")).alias("rule_path"), F.col("verdict").alias("rule_verdict"),
    )
    digest = _digest(F.concat("rule_host", F.regexp_extract("rule_path", r"(?s)^(.*/)", 1)))
    return rules.distinct().withColumns({"digest": digest, "short": _short(digest)})


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of `pages`: id, url, host, path, rule (host and path; null where none fits), verdict.

    Repeated rows come back as often as they came. A null url, or one without `://`, has an empty host and path and gets
    `default`. Other columns of `pages` are left out, so their names cannot clash.
    """
    rules = filed(rules)
    # one row of two numbers: how deep rules go
    deepest = rules.agg(F.max(_count(F.col("rule_host"), ".") + 1), F.max(_count(F.col("rule_path"), "/"))).first()
    labels, slashes = deepest[0] or 0, deepest[1] or 0

    urls = pages.groupBy(F.col(id_col).alias("id"), F.col(url_col).alias("url")).agg(F.count(F.lit(1)).alias("copies"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(labels), _count(F.col("host"), ".") + 1))),
        lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n),
    )
    depth = F.least(F.lit(slashes), _count(F.col("path"), "/"))
    prefixes = F.concat(F.array(F.lit("")), F.when(depth > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda n: F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), n), F.lit("/")),
    )).otherwise(F.array().cast("array<string>")))
    expressions = urls.select("*", F.explode(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))).alias("expression"))
    expressions = expressions.withColumn("own", _digest(F.col("expression"))).drop("expression")

    fits = (F.col("own") == F.col("digest")) & F.startswith("path", F.col("rule_path"))
    joined = expressions.withColumn("own_short", _short(F.col("own"))).join(rules, (F.col("own_short") == F.col("short")) & fits, "left")
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("length"), F.length("rule_host").alias("host_length"),
        (F.col("rule_verdict") == "block").alias("block"), "rule_host", "rule_path", "rule_verdict",
    )
    best = joined.groupBy("id", "url").agg(F.max(F.when(F.col("digest").isNotNull(), rank)).alias("best"), F.first("copies").alias("copies"))
    return best.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.concat("best.rule_host", "best.rule_path").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
