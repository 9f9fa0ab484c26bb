"""Explicit schemas and fixed vocabularies, in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT_VERSION = 3
QUALITY_VERSION = 1
ALGORITHM_VERSION = 4

# Accepted base forms, taxonomies in reading order, and the tags of each metric in order of preference.
FORMS = ("10-Q", "10-K", "20-F", "40-F", "6-K", "8-K")
REPORT_FORMS = ("10-Q", "10-K", "20-F", "40-F")
TAXONOMIES = ("us-gaap", "ifrs-full")
CONCEPTS = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet", "Revenue"),
    "net_income": ("NetIncomeLoss", "ProfitLossAttributableToOwnersOfParent", "ProfitLoss"),
    "operating_income": ("OperatingIncomeLoss", "ProfitLossFromOperatingActivities"),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities", "CashFlowsFromUsedInOperatingActivities"),
    "capex": (
        "PaymentsToAcquirePropertyPlantAndEquipment",
        "PaymentsForAdditionsToPropertyPlantAndEquipment",
        "PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities",
        "PaymentsToAcquireProductiveAssets",
    ),
    "eps": ("EarningsPerShareDiluted", "DilutedEarningsLossPerShare"),
    "share_compensation": ("ShareBasedCompensation",),
    "diluted_shares": ("WeightedAverageNumberOfDilutedSharesOutstanding",),
}
INSTANT_CONCEPTS = {
    "equity": ("StockholdersEquity", "EquityAttributableToOwnersOfParent"),
    "cash": ("CashAndCashEquivalentsAtCarryingValue",),
    "current_long_debt": ("LongTermDebtCurrent",),
    "noncurrent_long_debt": ("LongTermDebtNoncurrent",),
    "short_borrowings": ("ShortTermBorrowings",),
    "commercial_paper": ("CommercialPaper",),
}
UNITS = {"eps": "USD/shares", "diluted_shares": "shares"}
FLOW_METRICS = ("revenue", "net_income", "operating_income", "operating_cash_flow", "capex")

FACT_ITEM = T.StructType([
    T.StructField("start", T.StringType()), T.StructField("end", T.StringType()),
    T.StructField("filed", T.StringType()), T.StructField("form", T.StringType()),
    T.StructField("accn", T.StringType()), T.StructField("val", T.StringType()),
])
UNIT_MAP = T.StructType([T.StructField("units", T.MapType(T.StringType(), T.ArrayType(FACT_ITEM)))])
FACT_MAP = T.MapType(T.StringType(), T.MapType(T.StringType(), UNIT_MAP))
FACTS_DOCUMENT = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("cik", T.StringType()), T.StructField("facts", FACT_MAP)])

PRICE_ROW = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("close", T.StringType()), T.StructField("pos", T.LongType()),
])
QUOTE_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in (
    "symbol", "last", "change_pct", "open", "high", "low", "volume", "last_timedate", "last_time")])
QUOTE_PAYLOAD = T.StructType([
    T.StructField("captured_at", T.StringType()), T.StructField("quotes", T.StringType())])
FILING_FIELDS = ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument", "items")
FILING_ARRAYS = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in FILING_FIELDS])
CATALOG_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("ticker", "title", "cik_str")])
SUPPLEMENT_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in (
    "start", "end", "filed", "form", "accn", "val")])


def concept_map(spark: SparkSession, concepts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Fixed-size lookup (metric, concept, priority, unit): one row per tag of the vocabulary, never data-sized.

    The rows are literals, so Spark knows how small the table is.
    """
    rows = [
        F.struct(F.lit(metric).alias("metric"), F.lit(concept).alias("concept"), F.lit(priority).alias("priority"), F.lit(UNITS.get(metric, "USD")).alias("unit"))
        for metric, names in (concepts or {**CONCEPTS, **INSTANT_CONCEPTS}).items()
        for priority, concept in enumerate(names)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def taxonomy_rank(column):
    """Reading order of the two accepted taxonomies; null for any other."""
    rank = F.lit(None).cast("int")
    for position, name in enumerate(TAXONOMIES):
        rank = F.when(F.col(column) == name, F.lit(position)).otherwise(rank)
    return rank
