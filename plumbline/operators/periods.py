"""Point-in-time period resolution: what each filer had disclosed, by metric and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators.matching import dealt, lookup_join
from plumbline.schemas import taxonomy_rank

DETAIL = ("val", "filed", "form", "accn", "concept")


def as_date(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def early(day: Column) -> Column:
    """Greater for earlier days, to break ties toward the first row."""
    return F.datediff(F.lit("1970-01-01").cast("date"), day)


def observations(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """Accepted duration facts with metric and tag priority: known form and taxonomy, finite value, 50 to 400 days."""
    rows = facts.withColumn("taxonomy_rank", taxonomy_rank("taxonomy")).where(
        S.accepted_form(F.col("form")) & F.col("taxonomy_rank").isNotNull() & F.col("filed").isNotNull()
        & S.finite(F.col("val")) & S.accepted_span(S.period_days(F.col("start"), F.col("end")))
    )
    return lookup_join(rows, concepts, ["concept", "unit"], ["symbol", "end", "filed"])


def compact(obs: DataFrame) -> DataFrame:
    """One row per (symbol, metric, start, end, filed): no later resolution can pick another one.

    What is left per symbol is bounded by dates, so steps that gather a symbol's periods stay small however many raw
    rows the symbol has. Worth writing as a table partitioned by metric.
    """
    return (
        obs.groupBy("symbol", "metric", "start", "end", "filed")
        .agg(F.max_by(F.struct("val", "form", "accn", "concept", "unit", "priority", "taxonomy_rank", "pos"), winner_order()).alias("w"))
        .select("symbol", "metric", "start", "end", "filed", "w.*")
    )


def split_factor(filed: Column, splits: Column, as_of: Column) -> Column:
    """Product of the split ratios that took effect after a row was filed and by the run date."""
    later = F.filter(splits, lambda s: (s["effective_date"] > filed) & (s["effective_date"] <= as_of))
    return F.aggregate(later, F.lit(1.0), lambda product, s: product * s["ratio"])


def with_split_factor(rows: DataFrame, policy: DataFrame | None, as_of: Column) -> DataFrame:
    """Restate values on today's share basis. Symbols absent from the policy are dropped: absent is not "no splits"."""
    if policy is None:
        return rows.withColumn("reported_value", F.col("val")).withColumn("split_adjustment", F.lit(1.0))
    return (
        rows.join(policy.select("symbol", "splits"), "symbol")
        .withColumn("split_adjustment", split_factor(F.col("filed"), F.col("splits"), as_of))
        .withColumn("reported_value", F.col("val"))
        .withColumn("val", F.col("val") / F.col("split_adjustment"))
        .drop("splits")
    )


def winner_order() -> Column:
    """Latest filed, then the preferred tag, then the row listed last."""
    return F.struct("filed", -F.col("priority"), F.col("taxonomy_rank"), F.col("pos"))


def known_by(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.where((F.col("filed") <= as_of) & (F.col("end") <= as_of))


def periods_as_of(obs: DataFrame, as_of, policy: DataFrame | None = None) -> DataFrame:
    """The winning row of every (symbol, metric, start, end) among those known on `as_of`."""
    as_of = as_date(as_of)
    winners = (
        known_by(obs, as_of).groupBy("symbol", "metric", "start", "end")
        .agg(F.max_by(F.struct(*DETAIL), winner_order()).alias("w"))
        .select("symbol", "metric", "start", "end", "w.*")
    )
    return with_split_factor(winners, policy, as_of)


def validity(obs: DataFrame) -> DataFrame:
    """Every winning row of a (symbol, metric, start, end) with the days it wins: `[known_from, known_to)`, open at the end.

    A row is known once it is filed and its period has ended. Filing dates decide first, so the winner changes only where a
    later known row appears; rows known on one day are one step.
    """
    keys = ["symbol", "metric", "start", "end"]
    steps = obs.groupBy(*keys, F.greatest("filed", "end").alias("known_from")).agg(F.max_by(F.struct(*DETAIL), winner_order()).alias("w"))
    later = F.lead("known_from").over(W.partitionBy(*keys).orderBy("known_from"))
    return steps.withColumn("known_to", later).select(*keys, "known_from", "known_to", "w.*")


def dates_by_year(dates: DataFrame) -> DataFrame:
    """(symbol, as_of) rows to one row per symbol: a map from year to that year's dates, in order."""
    yearly = dates.where("as_of IS NOT NULL").groupBy("symbol", F.year("as_of").alias("year")).agg(F.array_sort(F.collect_set("as_of")).alias("days"))
    return yearly.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("year", "days"))).alias("asked"))


def stabbed(since: Column, until: Column, asked: Column) -> Column:
    """The asked days inside `[since, until)`: whole years between the borders are taken as they are, only years at a border
    are filtered."""
    first = F.year(since)
    last = F.coalesce(F.year(until), F.array_max(F.map_keys(asked)))

    def of_year(year: Column) -> Column:
        days = F.coalesce(F.try_element_at(asked, year), F.array().cast("array<date>"))
        border = (year == first) | (year == F.year(until))
        return F.when(F.coalesce(border, F.lit(False)), F.filter(days, lambda d: (d >= since) & F.coalesce(d < until, F.lit(True)))).otherwise(days)

    return F.when(last >= first, F.flatten(F.transform(F.sequence(first, F.greatest(first, last)), of_year)))


def periods_as_of_dates(obs: DataFrame, dates, policy: DataFrame | None = None) -> DataFrame:
    """`periods_as_of` for many dates in one run, with a column `as_of`.

    `dates` is a list of days for all symbols, or a DataFrame (symbol, as_of); repeated pairs count once, null days and symbols
    without dates give no rows. Each winner is stabbed by the days of its symbol that lie in its interval of validity, looked
    up by calendar year inside the row: what moves is one row per winner and what comes out, not facts times dates.
    """
    if isinstance(dates, DataFrame):
        rows = validity(obs).join(dates_by_year(dates), "symbol")
    else:
        years: dict[int, list] = {}
        for day in sorted({str(d) for d in dates if d is not None}):
            years.setdefault(int(day[:4]), []).append(F.lit(day).cast("date"))
        if not years:
            return periods_as_of(obs.limit(0), "1970-01-01", policy).withColumn("as_of", F.lit(None).cast("date"))
        rows = validity(obs).withColumn("asked", F.create_map(*[x for year, days in years.items() for x in (F.lit(year), F.array(*days))]))
    found = rows.withColumn("as_of", F.explode(stabbed(F.col("known_from"), F.col("known_to"), F.col("asked")))).drop("known_from", "known_to", "asked")
    return with_split_factor(found, policy, F.col("as_of"))


def knowledge_summary(obs: DataFrame) -> DataFrame:
    """For every filing date of a (symbol, metric): periods known by then, restated ones, and the latest end.

    Equal to joining facts with filing dates on `filed <= date`, but computed from the change points alone: each
    period adds one on the day it becomes known, and running sums do the rest. One row per day bounds each window.
    """
    keys = ["symbol", "metric"]
    seen = F.greatest("filed", "end")
    days = obs.select(*keys, seen.alias("day"), "filed", "start", "end")
    per_period = days.groupBy(*keys, "start", "end", "day").agg(F.max("filed").alias("filed"))
    order = W.partitionBy(*keys, "start", "end").orderBy("day")
    changes = (
        per_period.withColumn("version", F.row_number().over(order))
        .groupBy(*keys, "day").agg(
            F.count_if(F.col("version") == 1).alias("new"), F.count_if(F.col("version") == 2).alias("redone"),
            F.max("end").alias("last_end"))
    )
    dates = obs.groupBy(*keys, F.col("filed").alias("day")).agg(F.lit(True).alias("is_filing"))
    run = W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        changes.join(dates, [*keys, "day"], "full")
        .select(
            *keys, F.col("day").alias("as_of"), "is_filing",
            F.coalesce(F.sum("new").over(run), F.lit(0)).alias("periods_known"),
            F.coalesce(F.sum("redone").over(run), F.lit(0)).alias("periods_restated"),
            F.max("last_end").over(run).alias("latest_end"),
        )
        .where("is_filing").drop("is_filing")
    )


def standalone_quarters(periods: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One quarter per (symbol, metric, end): the directly reported one, else a cumulative minus the one before it.

    The previous cumulative is found by a range frame of 60 to 110 days over rows that share a start, so no self join.
    `carry` names columns that depend on (symbol, metric) alone and are kept.
    """
    day = F.datediff(F.col("end"), F.lit("1970-01-01").cast("date"))
    before = W.partitionBy("symbol", "metric", "start").orderBy("_day").rangeBetween(-110, -60)
    rows = periods.withColumn("_day", day).withColumn(
        "_prior", F.max(F.struct("end", "val", "filed")).over(before)
    )
    direct = S.quarter_span(S.period_days(F.col("start"), F.col("end")))
    candidate = F.when(
        direct,
        F.struct("start", *DETAIL, F.lit(False).alias("derived")),
    ).when(
        F.col("_prior").isNotNull(),
        F.struct(
            F.date_add(F.col("_prior.end"), 1).alias("start"), (F.col("val") - F.col("_prior.val")).alias("val"),
            F.greatest("filed", "_prior.filed").alias("filed"), "form", "accn", "concept", F.lit(True).alias("derived"),
        ),
    )
    rank = F.struct(
        direct.alias("direct"), F.when(direct, F.col("filed")).alias("filed"),
        early(F.col("start")).alias("early"),
    )
    return (
        rows.where(direct | F.col("_prior").isNotNull())
        .groupBy("symbol", "metric", "end", *carry).agg(F.max_by(candidate, rank).alias("q"))
        .select("symbol", "metric", "end", *carry, "q.*")
    )


def direct_quarters(periods: DataFrame) -> DataFrame:
    """The latest filed directly reported quarter per end; on equal filing dates the one that starts last."""
    return (
        periods.where(S.quarter_span(S.period_days(F.col("start"), F.col("end"))))
        .groupBy("symbol", "metric", "end")
        .agg(F.max_by(F.struct(F.struct("*").alias("row")), F.struct("filed", "start")).alias("w"))
        .select("w.row.*")
    )


def mark_four_in_a_row(quarters: DataFrame, keys: list[str], gap_low: int, gap_high: int) -> DataFrame:
    """Adds, at each quarter, whether it closes four contiguous quarters that span a year, and their sum.

    The gap is this start minus the previous end in days. The four values are added oldest first.
    """
    order = W.partitionBy(*keys).orderBy("end")
    rows = quarters.withColumn("_joined", F.datediff(F.col("start"), F.lag("end").over(order)).between(gap_low, gap_high))
    joined = F.col("_joined") & F.lag("_joined", 1).over(order) & F.lag("_joined", 2).over(order)
    total = F.lag("val", 3).over(order) + F.lag("val", 2).over(order) + F.lag("val", 1).over(order) + F.col("val")
    first = F.lag("start", 3).over(order)
    return rows.withColumns({
        "year_start": first, "year_val": total, "year_filed": F.max("filed").over(order.rowsBetween(-3, 0)),
        "year_ok": F.coalesce(joined & S.annual_span(F.datediff(F.col("end"), first)), F.lit(False)),
    }).drop("_joined")


def four_in_a_row(quarters: DataFrame, keys: list[str], gap_low: int, gap_high: int) -> DataFrame:
    """Trailing four quarters ending at each quarter, where they are contiguous and span a year."""
    rows = mark_four_in_a_row(quarters, keys, gap_low, gap_high).where("year_ok")
    return rows.withColumns({"start": F.col("year_start"), "val": F.col("year_val"), "filed": F.col("year_filed")}).drop(
        "year_start", "year_val", "year_filed", "year_ok")


def latest_ends(periods: DataFrame) -> DataFrame:
    return periods.groupBy("symbol", "metric").agg(F.max("end").alias("latest_end"))


def with_latest_end(periods: DataFrame) -> DataFrame:
    """Adds the latest end of the (symbol, metric); resolved periods are few per symbol, so this is a plain window."""
    return periods.withColumn("latest_end", F.max("end").over(W.partitionBy("symbol", "metric")))


def trailing_year(periods: DataFrame) -> DataFrame:
    """Trailing twelve months per (symbol, metric), by the first rule that applies:

    1 an annual period ending now; 2 last annual + current year-to-date - the comparable one; 3 four contiguous quarters.
    Rows are brought together once by (symbol, metric) or coarser; windows, aggregates and the last join keep that
    partitioning. Only rows near the latest end take part, which bounds every group by dates rather than by data.
    """
    keys = ["symbol", "metric"]
    columns = ["start", "end", "val", "filed", "form", "accn"]
    near = with_latest_end(periods)
    span = S.period_days(F.col("start"), F.col("end"))
    ending = F.col("end") == F.col("latest_end")

    year_ago = F.abs(F.datediff("latest_end", "end") - 365) <= 14
    comparable = F.max_by(
        F.struct("end", "val", "filed"), F.when(year_ago, F.struct("filed", early(F.col("end"))))
    ).over(W.partitionBy(*keys, "start"))
    rows = near.withColumn("_comparable", comparable)
    anchor = F.when(
        S.annual_span(span) & (F.datediff("latest_end", "end") <= 408) & F.col("_comparable").isNotNull(),
        F.struct("end", "start", "val", "filed", F.col("_comparable").alias("prior")),
    )
    rows = rows.withColumn("_anchors", F.collect_list(anchor).over(W.partitionBy(*keys))).where(ending)
    fitting = F.filter("_anchors", lambda a: F.datediff(F.col("start"), a["end"]).between(0, 8))
    rows = rows.withColumn("_anchor", F.get(F.array_sort(fitting), F.lit(0)))
    base, prior = F.col("_anchor"), F.col("_anchor.prior")
    rolled = F.struct(
        F.date_add(prior["end"], 1).alias("start"), "end", (base["val"] + F.col("val") - prior["val"]).alias("val"),
        F.greatest(base["filed"], "filed", prior["filed"]).alias("filed"), "form", "accn")
    direct = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*columns), F.when(S.annual_span(span), F.struct("filed", early(F.col("start"))))).alias("annual"),
        F.min_by(rolled, F.when(base.isNotNull(), F.col("start"))).alias("rolled"),
    )

    quarters = standalone_quarters(near, carry=("latest_end",)).where(F.datediff("latest_end", "end") <= 400)
    summed = four_in_a_row(quarters, keys, 0, 8).where(ending).select(*keys, F.struct(*columns).alias("summed"))

    rule = F.when(F.col("annual").isNotNull(), 1).when(F.col("rolled").isNotNull(), 2).when(F.col("summed").isNotNull(), 3)
    return (
        direct.join(summed, keys, "left").withColumn("rule", rule).where("rule IS NOT NULL")
        .select(*keys, "rule", F.coalesce("annual", "rolled", "summed").alias("t")).select(*keys, "rule", "t.*")
    )


def trailing_eps(periods: DataFrame) -> DataFrame:
    """Sum of the last four directly reported quarters per (symbol, metric); never derived by subtraction."""
    keys = ["symbol", "metric"]
    quarters = direct_quarters(with_latest_end(periods)).where(F.datediff("latest_end", "end") <= 400)
    return four_in_a_row(quarters, keys, 1, 1).where(F.col("end") == F.col("latest_end")).drop("latest_end")


def earnings_timeline(obs: DataFrame, policy: DataFrame, as_of, tasks: int | None = None) -> DataFrame:
    """One event per distinct filing date of a symbol: the trailing EPS known then, effective the next day.

    The reference quarter set of a date can only hold quarters within 400 days of the latest known end, so each date
    looks up that handful among the symbol's quarter ends (a list bounded by dates) and takes each one's version as of the
    date (an as-of join per quarter). Work grows with filing dates, not with facts times dates. Events without a valid sum
    keep a null `eps`; they end the event before them. `tasks`: how many tasks the symbols are dealt to, where the caller
    knows the size of the input.
    """
    as_of = as_date(as_of)
    eps = obs.where((F.col("metric") == "eps") & (F.col("filed") <= as_of))
    rows = with_split_factor(dealt(eps, tasks, "symbol"), policy, as_of).withColumn("seen", F.greatest("filed", "end"))

    # per day: was something filed, and the latest end known by then
    moment = F.explode(F.array_distinct(F.array("filed", "seen")))
    moments = rows.select("symbol", "filed", "seen", "end", moment.alias("t")).groupBy("symbol", "t").agg(
        F.bool_or(F.col("t") == F.col("filed")).alias("is_filing"), F.max(F.when(F.col("t") == F.col("seen"), F.col("end"))).alias("end"))
    run = W.partitionBy("symbol").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    latest = moments.withColumn("period_end", F.max("end").over(run)).where("is_filing").select(
        "symbol", F.col("t").alias("filed_at"), "period_end")

    direct = rows.where(S.quarter_span(S.period_days(F.col("start"), F.col("end")))).withColumnRenamed("end", "q_end")
    detail = ("start", "filed", "val", "reported_value", "split_adjustment", "accn")
    versions = (
        direct.groupBy("symbol", "q_end", "seen")
        .agg(F.max_by(F.struct(*detail), F.struct("filed", "start", -F.col("priority"), "taxonomy_rank", "pos")).alias("_event"))
        .select("symbol", "q_end", F.col("seen").alias("t"), F.lit(0).alias("side"), "_event")
    )
    quarter_ends = direct.groupBy("symbol").agg(F.collect_set("q_end").alias("_ends"))
    near = F.filter("_ends", lambda end: F.datediff(end, F.col("period_end")).between(-400, 0))
    wanted = latest.join(quarter_ends, "symbol").select("symbol", "filed_at", "period_end", F.explode(near).alias("q_end"))
    # one bare row per date keeps dates without any quarter
    asked = wanted.unionByName(latest.withColumn("q_end", F.lit(None).cast("date"))).select(
        "symbol", "q_end", F.col("filed_at").alias("t"), F.lit(1).alias("side"), "period_end")

    # a handful of rows per filing date: bring each symbol together once, everything below keeps that partitioning
    both = asked.unionByName(versions, allowMissingColumns=True)
    both = dealt(both, tasks, "symbol") if tasks else both.repartition("symbol")
    backward = W.partitionBy("symbol", "q_end").orderBy("t", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    known = both.withColumn("event", F.last("_event", ignorenulls=True).over(backward)).where("side = 1")

    component = F.struct(
        F.col("event.start").alias("start"), F.col("q_end").alias("end"), F.col("event.filed").alias("filed_at"),
        F.col("event.val").alias("eps"), F.col("event.reported_value").alias("reported_eps"),
        F.col("event.split_adjustment").alias("split_adjustment"), F.col("event.accn").alias("accession"),
    )
    quarters = known.where("q_end IS NULL OR event IS NOT NULL").select(
        "symbol", F.col("t").alias("filed_at"), "period_end", F.col("q_end").alias("end"), "event.start", "event.val", "event.filed",
        "event.accn", component.alias("component"),
    )
    keys = ["symbol", "filed_at"]
    order = W.partitionBy(*keys).orderBy("end")
    components = F.array(*[F.lag("component", back).over(order) for back in (3, 2, 1)], F.col("component"))
    total = mark_four_in_a_row(quarters.withColumn("components", components), keys, 1, 1)
    valid = F.col("year_ok") & (F.col("end") == F.col("period_end"))
    events = total.groupBy(*keys, "period_end").agg(
        F.max_by(F.struct(F.col("year_val").alias("eps"), F.col("accn").alias("accession"), "components"), F.when(valid, F.col("end"))).alias("e"))
    return events.select(
        "symbol", F.date_add("filed_at", 1).alias("available_on"), "filed_at", "period_end", "e.eps", "e.accession",
        F.when(F.col("e.eps").isNull(), "four_quarters_missing").alias("reason"), "e.components",
    )


def period_type(periods: DataFrame) -> DataFrame:
    """Basis of the latest end per (symbol, metric): a quarter when resolvable, else the earliest start as annual or ytd."""
    keys = ["symbol", "metric"]
    near = with_latest_end(periods)
    fallback = near.where(F.col("end") == F.col("latest_end")).groupBy(*keys).agg(F.min_by(F.struct("start", "end", *DETAIL), "start").alias("p"))
    quarters = standalone_quarters(near, carry=("latest_end",)).where(F.col("end") == F.col("latest_end")).select(
        *keys, F.struct("start", "end", *DETAIL).alias("q"))
    kind = (
        F.when(F.col("q").isNotNull(), "quarter")
        .when(F.datediff("p.end", "p.start") >= 330, "annual").otherwise("ytd")
    )
    return fallback.join(quarters, keys, "left").select(
        *keys, kind.alias("period_type"), F.coalesce("q", "p").alias("b")).select(*keys, "period_type", "b.*")
