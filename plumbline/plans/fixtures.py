"""Input views for the operators, derived from the business tables with partial aggregation before every shuffle.

All money is summed as whole cents, so results do not depend on the order of summation.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import input_tasks, landed

AS_OF = date(2001, 11, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and shipping day, before any join. Most rows have a day of their own, so they are dealt by supplier
    and day first: a task hashes its share, not what fits into one file split."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    discount = F.round(F.col("l_discount") * 100).cast("long")
    tax = F.round(F.col("l_tax") * 100).cast("long")
    flag = F.col("l_returnflag")
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            "l_suppkey",
            F.col("l_shipdate").cast("date").alias("date"),
            cents.alias("cents"),
            F.col("l_quantity").cast("long").alias("qty"),
            (cents * (20 - 4 * discount + F.when(flag == "A", 10).otherwise(0))).alias("income"),
            (cents * (15 - discount - F.when(flag == "R", 12).otherwise(0))).alias("operating"),
            (cents * (12 - tax)).alias("cash_flow"),
            (cents * (2 * F.col("l_linenumber"))).alias("capex"),
        )
        .repartition(input_tasks(spark, sf_dir), "l_suppkey", "date")
        .groupBy("l_suppkey", "date")
        .agg(*[F.sum(c).alias(c) for c in ("cents", "qty", "income", "operating", "cash_flow", "capex")])
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to symbol: its region, its nation and itself, told apart by `level`."""
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "s_acctbal", F.posexplode(F.array("r_name", "n_name", "s_name")).alias("level", "symbol"))
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "prices", lambda: build_prices(spark, sf_dir))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "facts", lambda: build_facts(spark, sf_dir))


def build_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily close per symbol, four decimals. Regions and nations shrink to one row per task and day before they move; most rows
    are a supplier's own days, dealt to as many tasks as the input asks for."""
    tasks = input_tasks(spark, sf_dir)
    close = F.floor(F.sum("cents") * F.lit(100.0) / F.sum("qty") + F.lit(0.5)) / F.lit(10000.0)
    days = (
        supplier_days(spark, sf_dir).select("l_suppkey", "date", "cents", "qty").repartition(tasks, "l_suppkey")
        .join(entities(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    own = days.where("level = 2").select("symbol", "date", "cents", "qty")
    shared = days.where("level < 2").groupBy("symbol", "date").agg(F.sum("cents").alias("cents"), F.sum("qty").alias("qty"))
    return own.unionByName(shared).repartition(tasks, "symbol", "date").groupBy("symbol", "date").agg(close.alias("close"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "calendar", lambda: build_calendar(spark, sf_dir))


def build_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays between the first and the last shipping day; closes at 21:00 UTC."""
    span = table(spark, sf_dir, "lineitem").agg(
        F.min("l_shipdate").cast("date").alias("first"), F.max("l_shipdate").cast("date").alias("last")
    )
    return (
        span.select(F.explode(F.sequence("first", "last")).alias("session_date"))
        .where(F.weekday("session_date") < 5)
        .withColumn("close_ts", F.col("session_date").cast("timestamp") + F.expr("INTERVAL 21 HOURS"))
    )


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "splits", lambda: build_splits(spark, sf_dir))


def build_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split policy: ratios for two regions, none elsewhere; suppliers ending in 7 have no known policy."""
    symbols = entities(spark, sf_dir).select("symbol").distinct()
    item = "array<struct<effective_date:date,ratio:double>>"
    ratios = (
        F.when(F.col("symbol") == "AMERICA", F.expr(
            "array(struct(date'1997-06-02' as effective_date, 4D as ratio), struct(date'1999-03-01' as effective_date, 10D as ratio))"))
        .when(F.col("symbol") == "ASIA", F.expr("array(struct(date'1998-07-20' as effective_date, 20D as ratio))"))
        .otherwise(F.array().cast(item))
    )
    return symbols.where(~F.col("symbol").endswith("7")).withColumn("splits", ratios.cast(item))


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "quarters", lambda: build_quarters(spark, sf_dir))


def build_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter sums per symbol with year-to-date totals; `n` numbers the quarters from 1995."""
    sums = ("cents", "qty", "income", "operating", "cash_flow", "capex")
    by_quarter = (
        supplier_days(spark, sf_dir)
        .withColumn("qs", F.trunc("date", "quarter"))
        .repartition(input_tasks(spark, sf_dir), "l_suppkey")
        .groupBy("l_suppkey", "qs")
        .agg(*[F.sum(c).alias(c) for c in sums])
        .join(entities(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("symbol", "qs")
        .agg(*[F.sum(c).alias(c) for c in sums])
        .select(
            "symbol", "qs", F.last_day(F.add_months("qs", 2)).alias("qe"), F.trunc("qs", "year").alias("ys"),
            F.quarter("qs").alias("q"), ((F.year("qs") - 1995) * 4 + F.quarter("qs") - 1).alias("n"), *sums,
        )
    )
    year = W.partitionBy("symbol", "ys").orderBy("qs").rowsBetween(W.unboundedPreceding, W.currentRow)
    life = W.partitionBy("symbol").orderBy("qs").rowsBetween(W.unboundedPreceding, W.currentRow)
    return by_quarter.repartition(input_tasks(spark, sf_dir), "symbol").select(
        "*",
        F.count("*").over(year).alias("known"),
        *[F.sum(c).over(year).alias(f"ytd_{c}") for c in sums],
        F.sum("cents").over(life).alias("life_cents"),
    )


def _fact(kind, taxonomy, concept, unit, start, end, filed, form, val, when):
    item = F.struct(
        F.lit(taxonomy).alias("taxonomy"), F.lit(concept).alias("concept"), F.lit(unit).alias("unit"),
        start.alias("start"), end.alias("end"), filed.alias("filed"), F.lit(form).alias("form"),
        F.concat_ws("-", "symbol", F.col("n").cast("string"), F.lit(str(kind))).alias("accn"),
        val.cast("double").alias("val"), (F.lit(kind).cast("long") * 1000 + F.col("n")).alias("pos"),
    )
    return F.when(when, item)


def build_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw dated facts (duration and balance rows), one pass over the quarter table."""
    c = F.col
    q, n, qs, qe, ys = c("q"), c("n"), c("qs"), c("qe"), c("ys")
    none = F.lit(None).cast("date")
    money, pct = F.lit(100.0), F.lit(10000.0)
    rev, ytd_rev = c("cents") / money, c("ytd_cents") / money
    inc, ytd_inc = c("income") / pct, c("ytd_income") / pct
    shares = F.lit(1000000.0) + n * F.lit(1000.0)
    eps, ytd_eps = inc / shares, ytd_inc / shares
    interim, later, year = q < 4, q.isin(2, 3), (q == 4) & (c("known") == 4)
    whole = q == c("known")
    has_eps = c("cents") % 11 != 0
    in10q, in10k, in8k, in10qa = (F.date_add(qe, d) for d in (35, 60, 30, 200))
    rows = [
        _fact(1, "us-gaap", "Revenues", "USD", qs, qe, in10q, "10-Q", rev + 1, interim),
        _fact(2, "us-gaap", "RevenueFromContractWithCustomerExcludingAssessedTax", "USD", qs, qe, in10q, "10-Q", rev, interim & (n >= 12)),
        _fact(3, "us-gaap", "Revenues", "USD", ys, qe, in10q, "10-Q", ytd_rev, later & whole),
        _fact(4, "us-gaap", "Revenues", "USD", ys, qe, in10k, "10-K", ytd_rev, year),
        _fact(5, "ifrs-full", "Revenues", "USD", qs, qe, in10q, "10-Q", rev + 2, interim & (n % 4 == 1)),
        _fact(6, "us-gaap", "Revenues", "USD", qs, qe, in10qa, "10-Q/A", rev * 1.02, interim & (n % 5 == 0)),
        _fact(7, "us-gaap", "Revenues", "USD", qs, qe, in10q, "S-1", rev * 3, n % 7 == 0),
        _fact(8, "us-gaap", "Revenues", "USD", F.date_sub(qe, 20), qe, in10q, "10-Q", rev / 4, n % 7 == 1),
        _fact(9, "us-gaap", "Revenues", "USD", qs, qe, F.date_add(in10q, 1), "10-Q", F.lit(None), n % 7 == 2),
        _fact(10, "us-gaap", "NetIncomeLoss", "USD", qs, qe, in10q, "10-Q", inc, interim),
        _fact(11, "us-gaap", "NetIncomeLoss", "USD", ys, qe, in10q, "10-Q", ytd_inc, later & whole),
        _fact(12, "us-gaap", "NetIncomeLoss", "USD", ys, qe, in10k, "10-K", ytd_inc, year),
        _fact(13, "ifrs-full", "ProfitLoss", "USD", qs, qe, in10q, "10-Q", inc + 5, interim & (n % 3 == 0)),
        _fact(14, "us-gaap", "OperatingIncomeLoss", "USD", qs, qe, in10q, "10-Q", c("operating") / pct, interim),
        _fact(15, "us-gaap", "OperatingIncomeLoss", "USD", ys, qe, in10q, "10-Q", c("ytd_operating") / pct, later & whole),
        _fact(16, "us-gaap", "OperatingIncomeLoss", "USD", ys, qe, in10k, "10-K", c("ytd_operating") / pct, year),
        _fact(17, "us-gaap", "NetCashProvidedByUsedInOperatingActivities", "USD", ys, qe, in10q, "10-Q", c("ytd_cash_flow") / pct, interim & whole),
        _fact(18, "us-gaap", "NetCashProvidedByUsedInOperatingActivities", "USD", ys, qe, in10k, "10-K", c("ytd_cash_flow") / pct, year),
        _fact(19, "us-gaap", "PaymentsToAcquirePropertyPlantAndEquipment", "USD", ys, qe, in10q, "10-Q", c("ytd_capex") / pct, interim & whole),
        _fact(20, "us-gaap", "PaymentsToAcquirePropertyPlantAndEquipment", "USD", ys, qe, in10k, "10-K", c("ytd_capex") / pct, year),
        _fact(21, "us-gaap", "EarningsPerShareDiluted", "USD/shares", qs, qe, in10q, "10-Q", eps, interim & has_eps),
        _fact(22, "us-gaap", "EarningsPerShareDiluted", "USD/shares", qs, qe, in8k, "8-K", eps, (q == 4) & has_eps),
        _fact(23, "us-gaap", "EarningsPerShareDiluted", "USD/shares", ys, qe, in10k, "10-K", ytd_eps, year),
        _fact(24, "us-gaap", "EarningsPerShareDiluted", "USD/shares", qs, qe, in10qa, "10-Q/A", eps * 1.02, (n % 5 == 0) & has_eps),
        _fact(25, "us-gaap", "ShareBasedCompensation", "USD", ys, qe, in10q, "10-Q", c("ytd_qty") * F.lit(10.0), interim & whole),
        _fact(26, "us-gaap", "ShareBasedCompensation", "USD", ys, qe, in10k, "10-K", c("ytd_qty") * F.lit(10.0), year),
        _fact(27, "us-gaap", "WeightedAverageNumberOfDilutedSharesOutstanding", "shares", qs, qe, in10q, "10-Q", shares, interim),
        _fact(28, "us-gaap", "WeightedAverageNumberOfDilutedSharesOutstanding", "shares", ys, qe, in10k, "10-K", shares, year),
        _fact(29, "us-gaap", "StockholdersEquity", "USD", none, qe, in10q, "10-Q", c("life_cents") / F.lit(1000.0), F.lit(True)),
        _fact(30, "ifrs-full", "StockholdersEquity", "USD", none, qe, in10q, "10-Q", c("life_cents") / F.lit(1000.0) + 7, n % 2 == 0),
        _fact(31, "us-gaap", "CashAndCashEquivalentsAtCarryingValue", "USD", none, qe, in10q, "10-Q", c("cents") / F.lit(500.0), F.lit(True)),
        _fact(32, "us-gaap", "LongTermDebtCurrent", "USD", none, qe, in10q, "10-Q", c("qty") * F.lit(7.0), (c("symbol") != "EUROPE") & ~c("symbol").endswith("3")),
        _fact(33, "us-gaap", "LongTermDebtNoncurrent", "USD", none, qe, in10q, "10-Q", c("qty") * F.lit(90.0), F.lit(True)),
        _fact(34, "us-gaap", "ShortTermBorrowings", "USD", none, qe, in10q, "10-Q", c("qty") * F.lit(2.0), n % 2 == 0),
        _fact(35, "us-gaap", "CommercialPaper", "USD", none, qe, in10q, "10-Q", c("qty") * F.lit(3.0), n % 3 == 0),
    ]
    items = F.filter(F.array(*rows), lambda item: item.isNotNull())
    return quarters(spark, sf_dir).select("symbol", F.inline(items))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filing_rows(table(spark, sf_dir, "orders"))


def filing_rows(orders: DataFrame) -> DataFrame:
    """Filing rows from orders (batch or stream), keyed by customer."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    priority = F.substring("o_orderpriority", 1, 1)
    form = (
        F.when(priority == "1", "10-Q").when(priority == "2", "10-K").when(priority == "3", "8-K")
        .when(priority == "4", "6-K").otherwise("S-1")
    )
    return orders.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.col("o_custkey").cast("string").alias("cik"),
        F.concat(F.lpad(key.cast("string"), 10, "0"), F.lit("-"), F.lpad((key % 100).cast("string"), 2, "0")).alias("accession"),
        F.concat(form, F.when(key % 10 == 0, "/A").otherwise("")).alias("form"),
        day.alias("filed"),
        F.date_sub(F.trunc(day, "quarter"), 1).alias("report_date"),
        F.when((priority == "4") & (key % 3 == 0), F.concat(F.lit("q-Earnings-"), key.cast("string"), F.lit(".htm")))
        .otherwise(F.concat(F.lit("doc"), key.cast("string"), F.lit(".htm"))).alias("document"),
        F.when(priority == "3", F.when(key % 2 == 0, "2.02,9.01").otherwise("5.02")).otherwise("").alias("items"),
        F.col("o_custkey"),
    )


def nation_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same filings keyed by the customer's nation, so they share symbols with the facts."""
    place = (
        table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "n_name")
    )
    return (
        filings(spark, sf_dir).join(place, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("n_name").alias("symbol"), "cik", "accession", "form", "filed", "report_date", "document", "items")
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_rows(table(spark, sf_dir, "events"))


def quote_rows(events: DataFrame) -> DataFrame:
    """Raw quote texts from events (batch or stream); error events carry no price."""
    return events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
        F.col("ts").alias("captured_at"), "event_id",
        F.when(F.col("event_type") == "error", "N/A")
        .otherwise(F.concat(F.lit("$"), F.format_number(F.col("value") * 1000, 2))).alias("last"),
        F.concat(F.col("value").cast("string"), F.lit("%")).alias("change_pct"),
        F.get_json_object("props", "$.k").alias("volume"),
        F.col("event_type").alias("kind"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"),
        F.initcap("p_name").alias("name"),
        F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("cik"),
        F.array("p_brand").alias("aliases"), F.lit("US").alias("exchange"),
    )


def assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash-flow assumptions per customer; negative balances and a few odd rows hit the guards."""
    k = F.col("c_custkey")

    def number(column):
        return column.cast("double")

    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), k.cast("string")).alias("symbol"), (F.col("c_acctbal") / 100).alias("cash_per_share"),
        number(k % 9 - 2).alias("growth"), number(k % 5 + 8).alias("required_return"),
        F.when(k % 50 == 0, 20.0).otherwise(number(k % 4)).alias("terminal_growth"), number(k % 3 * 20).alias("safety_margin"),
        (number(k % 8 + 5) + F.when(k % 77 == 0, 0.5).otherwise(0.0)).alias("years"),
        F.when(k % 10 != 3, F.col("c_acctbal") / 4).alias("price"),
    )


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")

    def number(column):
        return column.cast("double")

    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), k.cast("string")).alias("symbol"), (F.col("c_acctbal") * 1e6).alias("annual_revenue"),
        F.when(k % 20 == 0, "TWD").otherwise("USD").alias("currency"), number(k % 30).alias("net_margin"),
        number(k % 25 + 10).alias("target_pe"), number(k + 1000000).alias("diluted_shares"), number(k % 40 - 5).alias("first_growth"),
        F.when(k % 6 != 0, number(k % 15)).alias("second_growth"), number(k % 5 - 2).alias("annual_share_change"),
        (k % 3).alias("years"), F.when(k % 10 != 3, number(k % 90) + 10.0).alias("price"),
    )
