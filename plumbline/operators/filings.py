"""Filing events: which count, which is newest, and whether structured data has caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators.matching import top_n_per_key
from plumbline.schemas import REPORT_FORMS

# The release item of an 8-K and the document names that mark a 6-K as a report.
RELEASE_ITEM = "2.02"
REPORT_DOCUMENT = "(?i)fsx|earn|result|quarter"


def relevant_filings(filings: DataFrame) -> DataFrame:
    """Periodic reports, 8-K earnings items and 6-K reports by document name, with an accession and a date."""
    base = S.base_form(F.col("form"))
    wanted = (
        base.isin(*REPORT_FORMS)
        | ((base == "8-K") & F.contains(F.col("items"), F.lit(RELEASE_ITEM)))
        | ((base == "6-K") & F.col("document").rlike(REPORT_DOCUMENT))
    )
    return filings.where(wanted & (F.col("accession") != "") & F.col("filed").isNotNull())


def latest_filing(filings: DataFrame) -> DataFrame:
    """Newest filing per symbol by filing date, then accession."""
    return (
        filings.groupBy("symbol").agg(F.max_by(F.struct("accession", "form", "filed", "report_date"), F.struct("filed", "accession")).alias("f"))
        .select("symbol", "f.*")
    )


def recent_filings(filings: DataFrame, n: int = 20) -> DataFrame:
    return top_n_per_key(filings, ["symbol"], [F.desc("filed"), F.desc("accession")], n)


def pending_report(latest: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Whether the newest filing is ahead of the structured snapshot, per symbol with a filing.

    Releases and amendments compare filing dates, periodic reports compare the report date with the period end; a
    symbol without a snapshot is pending.
    """
    known = snapshots.select("symbol", "period_end", F.col("filed_at").alias("_filed_at"))
    by_date = (S.base_form(F.col("form")) == "8-K") | F.col("form").endswith("/A")
    never = F.lit("0001-01-01").cast("date")
    pending = (
        F.when(F.col("period_end").isNull(), True)
        .when(by_date, F.coalesce("filed", never) > F.coalesce("_filed_at", never))
        .otherwise(F.coalesce("report_date", never) > F.col("period_end"))
    )
    return latest.join(known, "symbol", "left").withColumn("pending", pending).drop("_filed_at")


def changed_symbols(previous: DataFrame, latest: DataFrame) -> DataFrame:
    """Symbols whose newest accession differs from the stored one: their valuations are no longer fresh."""
    stored = previous.select("symbol", F.col("accession").alias("_stored"))
    return (
        latest.join(stored, "symbol", "left")
        .where(F.col("_stored").isNull() | (F.col("accession") != F.col("_stored"))).select("symbol", "accession")
    )


def with_urls(filings: DataFrame) -> DataFrame:
    return filings.withColumn("url", S.filing_url(F.col("cik"), F.col("accession"), F.col("document")))
