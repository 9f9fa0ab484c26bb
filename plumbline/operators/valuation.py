"""Daily multiples, coverage, ranks and the publishing gate.

Series are one row per symbol and day after the keep-last aggregate, so a window over a symbol is bounded by the
calendar, whatever share of the raw rows the symbol holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators.matching import asof_backward
from plumbline.operators.periods import as_date
from plumbline.schemas import ALGORITHM_VERSION

HORIZONS = (10, 5, 3, 1)
PERCENTILES = (20, 50, 80)
STALE_DAYS = 160


def valid_prices(prices: DataFrame, as_of) -> DataFrame:
    """Positive finite closes up to `as_of`, last row per date."""
    rows = prices.where(S.finite(F.col("close")) & (F.col("close") > 0) & (F.col("date") <= as_date(as_of)))
    if "pos" not in rows.columns:
        return rows
    return rows.groupBy("symbol", "date").agg(F.max_by("close", "pos").alias("close"))


def daily_states(prices: DataFrame, timeline: DataFrame, tasks: int | None = None) -> DataFrame:
    """Each price with the earnings event in force and its state, decided in the order missing, stale, loss, valid.

    `tasks`: how many tasks the symbols are dealt to, where the caller knows the size of the series."""
    fields = ["eps", "filed_at", "period_end"]
    matched = asof_backward(
        prices.select("symbol", "date", "close"), timeline, ["symbol"], "date", "available_on", fields, tasks=tasks)
    eps = F.col("event.eps")
    state = (
        F.when(eps.isNull(), "missing_eps")
        .when(F.datediff("date", "event.period_end") > STALE_DAYS, "stale_eps")
        .when(eps <= 0, "nonpositive_eps").otherwise("valid")
    )
    return matched.select(
        "symbol", "date", F.col("close").alias("price"), state.alias("state"), eps.alias("eps"),
        F.col("event.filed_at").alias("eps_filed_at"), F.col("event.period_end").alias("eps_period_end"),
    ).withColumn("pe", F.when(F.col("state") == "valid", F.col("price") / F.col("eps")))


def daily_pe(prices: DataFrame, timeline: DataFrame) -> DataFrame:
    return daily_states(prices, timeline).where("state = 'valid'").drop("state")


def empirical_rank(value: Column, current: Column) -> Column:
    """Share of values at or below the current one, in percent, ties included."""
    return S.half_up(F.lit(100.0) * F.count_if(value <= current) / F.count(value), 2)


def pe_percentile(samples: DataFrame, as_of, years: int = 10) -> DataFrame:
    """Rank of `current_pe` in a symbol's own window; `date` may be any text and the last row per date counts."""
    as_of = as_date(as_of)
    start = S.years_before(as_of, years)
    day, pe = S.safe_date(F.substring(F.col("date").cast("string"), 1, 10)), F.col("pe").cast("double")
    good = F.coalesce(day.between(start, as_of), F.lit(False)) & S.finite(pe) & (pe > 0)
    per_day = (
        samples.withColumn("day", F.when(good, day))
        .groupBy("symbol", "day")
        .agg(F.max_by(pe, "pos").alias("pe"), F.count("*").alias("rows"), F.max("current_pe").alias("current_pe"))
    )
    kept = F.col("day").isNotNull()
    value = F.when(kept, F.col("pe"))
    return (
        per_day.groupBy("symbol").agg(
            F.max("current_pe").alias("pe"),
            F.count(value).alias("sample_count"),
            F.coalesce(F.sum(F.when(~kept, F.col("rows"))), F.lit(0)).alias("excluded_count"),
            F.min("day").alias("history_start"), F.max("day").alias("history_end"),
            F.min(value).alias("minimum_pe"), F.max(value).alias("maximum_pe"),
            F.count_if(value <= F.col("current_pe")).alias("at_or_below"),
        )
        .where((F.col("sample_count") > 0) & S.finite(F.col("pe")) & (F.col("pe") > 0))
        .withColumn("percentile", S.half_up(F.lit(100.0) * F.col("at_or_below") / F.col("sample_count"), 2))
        .withColumn("window_start", start).withColumn("window_end", as_of).drop("at_or_below")
    )


def session_index(calendar: DataFrame, through=None) -> DataFrame:
    """(day, sessions_through): sessions on or before each day. A dimension of one row per calendar day.

    The running count has no partition key on purpose: its input is the calendar, about 260 rows a year.
    """
    span = calendar.agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
    last = F.greatest("b", as_date(through)) if through is not None else F.col("b")
    days = span.select(F.explode(F.sequence("a", last)).alias("day"))
    run = W.orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    sessions = calendar.select(F.col("session_date").alias("day"), F.lit(1).alias("is_session"))
    return days.join(sessions, "day", "left").select(
        "day", F.count("is_session").over(run).alias("sessions_through"),
        F.col("is_session").isNotNull().alias("is_session"),
    )


def with_sessions_through(df: DataFrame, index: DataFrame, day: str, name: str) -> DataFrame:
    """Adds the session count up to a day; days before the calendar count zero."""
    lookup = index.select(F.col("day").alias(day), F.col("sessions_through").alias(name))
    return df.join(lookup, day, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def coverage_windows(
    states: DataFrame, calendar: DataFrame, as_of, min_coverage: float = 0.995, max_unpriced: int = 2,
    max_gap: int = 3, min_samples_per_year: int = 200, horizons: tuple[int, ...] = HORIZONS,
) -> DataFrame:
    """Coverage counters and verdict per (symbol, years), ending at each symbol's last price.

    Sessions carry an ordinal, so expected sessions and missing runs follow from differences of ordinals; the product
    of symbols and sessions is never built. A loss day counts as covered, a day without price as missing. `as_of` is on
    or after every price.
    """
    index = session_index(calendar, as_of)
    priced = with_sessions_through(
        states.join(index.where("is_session").select(F.col("day").alias("date"), "is_session"), "date", "left"),
        index, "date", "_through",
    )
    everything = W.partitionBy("symbol")
    covered = F.col("state").isin("valid", "nonpositive_eps") & F.col("is_session")
    order = everything.orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    rows = (
        priced.withColumn("ordinal", F.when(covered, F.col("_through")))
        .withColumn("before", F.max("ordinal").over(order))
        .withColumn("valuation_date", F.max("date").over(everything))
        .withColumn("end_ordinal", F.max("_through").over(everything))
        .withColumn("current_pe", F.max(F.when(F.col("date") == F.col("valuation_date"), F.col("pe"))).over(everything))
    )
    windows = F.array(*[
        F.struct(F.lit(y).alias("years"), S.years_before(F.col("valuation_date"), y).alias("window_start")) for y in horizons
    ])
    bounds = (
        rows.select("symbol", "valuation_date", "end_ordinal").distinct()
        .select("symbol", "end_ordinal", F.inline(windows))
    )
    bounds = with_sessions_through(
        bounds.withColumn("_eve", F.date_sub("window_start", 1)), index, "_eve", "start_ordinal"
    ).drop("_eve")
    # one row per symbol and day: the horizons are told apart by conditions, not by copies of the row
    starts = bounds.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("years", F.struct("window_start", "start_ordinal")))).alias("_starts"))
    session = F.col("is_session")

    def counters(years: int):
        start = F.col("_starts")[F.lit(years)]
        inside = F.col("date") >= start["window_start"]
        gap = F.col("ordinal") - F.greatest(F.coalesce("before", F.lit(0)), start["start_ordinal"]) - 1
        first = F.first(start["start_ordinal"])
        return F.struct(
            F.lit(years).alias("years"), F.first(start["window_start"]).alias("window_start"), first.alias("start_ordinal"),
            F.count_if(inside & session).alias("priced_sessions"), F.count_if(inside & covered).alias("covered"),
            F.count_if(inside & session & (F.col("state") == "nonpositive_eps")).alias("nonpositive_sessions"),
            F.count(F.when(inside, F.col("pe"))).alias("valid_samples"), F.count_if(inside & (F.col("pe") <= F.col("current_pe"))).alias("at_or_below"),
            F.coalesce(F.max(F.when(inside, gap)), F.lit(0)).alias("inner_gap"), F.coalesce(F.max(F.when(inside, F.col("ordinal"))), first).alias("last_ordinal"),
        )

    counted = rows.join(starts, "symbol").groupBy("symbol", "valuation_date", "end_ordinal").agg(F.array(*map(counters, horizons)).alias("_horizons"))
    counted = counted.select("symbol", "valuation_date", "end_ordinal", F.inline("_horizons"))
    coverage = F.col("covered") / F.col("expected_sessions")
    qualified = (
        (coverage >= min_coverage) & (F.col("expected_sessions") - F.col("priced_sessions") <= max_unpriced)
        & (F.col("max_missing_run") <= max_gap) & (F.col("valid_samples") >= min_samples_per_year * F.col("years"))
    )
    return (
        counted.withColumn("expected_sessions", F.col("end_ordinal") - F.col("start_ordinal"))
        .where("expected_sessions > 0")
        .withColumn("max_missing_run", F.greatest("inner_gap", F.col("end_ordinal") - F.col("last_ordinal")))
        .withColumn("qualified", qualified)
        .select(
            "symbol", "years", "window_start", "valuation_date", "expected_sessions", "priced_sessions", "valid_samples",
            (F.col("expected_sessions") - F.col("covered")).alias("missing_sessions"), "nonpositive_sessions",
            S.half_up(coverage * 100, 3).alias("coverage_percent"), "max_missing_run", "qualified",
            F.when(F.col("qualified"), S.half_up(F.lit(100.0) * F.col("at_or_below") / F.col("valid_samples"), 2)).alias("percentile"),
        )
    )


def missing_sessions(states: DataFrame, calendar: DataFrame, as_of, years: int = 1) -> DataFrame:
    """Sessions of the window with no usable earnings state: the unmatched side of the calendar join, listed.

    Gaps between covered ordinals are expanded, so the output size is the only cost.
    """
    index = session_index(calendar, as_of)
    covered = with_sessions_through(
        states.where(F.col("state").isin("valid", "nonpositive_eps"))
        .join(index.where("is_session").select(F.col("day").alias("date")), "date"), index, "date", "ordinal")
    ends = states.groupBy("symbol").agg(F.max("date").alias("valuation_date"))
    ends = with_sessions_through(ends, index, "valuation_date", "end_ordinal")
    ends = ends.withColumn("_eve", F.date_sub(S.years_before(F.col("valuation_date"), years), 1))
    ends = with_sessions_through(ends, index, "_eve", "start_ordinal")
    edges = ends.select("symbol", "end_ordinal", "start_ordinal", F.explode(F.array("start_ordinal", F.col("end_ordinal") + 1)).alias("ordinal"))
    marks = (
        covered.join(ends, "symbol").where(F.col("ordinal") > F.col("start_ordinal"))
        .select("symbol", "end_ordinal", "start_ordinal", "ordinal").unionByName(edges)
    )
    order = W.partitionBy("symbol").orderBy("ordinal")
    gaps = marks.withColumn("before", F.lag("ordinal").over(order)).where(F.col("ordinal") - F.col("before") > 1)
    missing = gaps.select("symbol", F.explode(F.sequence(F.col("before") + 1, F.col("ordinal") - 1)).alias("ordinal"))
    named = index.where("is_session").select(F.col("sessions_through").alias("ordinal"), F.col("day").alias("session_date"))
    return missing.join(named, "ordinal").join(
        states.select("symbol", F.col("date").alias("session_date"), "state"), ["symbol", "session_date"], "left"
    ).select("symbol", "session_date", F.coalesce("state", F.lit("unpriced")).alias("state"))


def selected_horizon(windows: DataFrame) -> DataFrame:
    """The longest qualified window per symbol; `years` is null where none qualifies."""
    ok = F.when(F.col("qualified"), F.col("years"))
    ten = F.col("years") == max(HORIZONS)
    return windows.groupBy("symbol").agg(
        F.max("valuation_date").alias("valuation_date"), F.max(ok).alias("years"),
        F.max_by("percentile", ok).alias("percentile"),
        F.max(F.when(ten, F.col("percentile"))).alias("percentile10y"),
        F.max(F.when(ten, F.col("coverage_percent"))).alias("coverage10y"),
        F.max(F.when(ten, F.col("missing_sessions"))).alias("missing10y"),
    )


def samples_in_horizon(samples: DataFrame, selected: DataFrame) -> DataFrame:
    """Samples inside each symbol's selected window, the ten-year one where none qualifies."""
    start = S.years_before(F.col("valuation_date"), F.coalesce("years", F.lit(max(HORIZONS))))
    return samples.join(selected, "symbol").where(F.col("date") >= start)


def quantiles(samples: DataFrame, keys: list[str], value: str = "pe", percentiles: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """Exact interpolated quantiles in long form; a group has one value per trading day at most."""
    fractions = F.array(*[F.lit(p / 100) for p in percentiles])
    points = samples.groupBy(*keys).agg(F.percentile(value, fractions).alias("_q"))
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in percentiles]).alias("percentile"), F.col("_q").alias("pe"))
    return points.select(*keys, F.inline(pairs).alias("percentile", "pe"))


def reference_prices(samples: DataFrame, selected: DataFrame, current_eps: DataFrame) -> DataFrame:
    """P20, P50 and P80 multiples of the qualified window times the earnings in force."""
    inside = samples_in_horizon(samples, selected.where(F.col("years").isNotNull()))
    return quantiles(inside, ["symbol"]).join(current_eps, "symbol").select(
        "symbol", "percentile", "pe", (F.col("pe") * F.col("eps")).alias("price"))


def split_continuity(prices: DataFrame, policy: DataFrame, as_of, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Close before and after each split; a ratio outside the band marks the symbol as rejected."""
    events = policy.select("symbol", F.inline("splits")).where(F.col("effective_date") <= as_date(as_of))
    sides = prices.join(events, "symbol").groupBy("symbol", "effective_date", F.col("ratio").alias("split_ratio")).agg(
        F.max_by("close", F.when(F.col("date") < F.col("effective_date"), F.col("date"))).alias("price_before"),
        F.min_by("close", F.when(F.col("date") >= F.col("effective_date"), F.col("date"))).alias("price_after"),
    )
    ratio = F.col("price_before") / F.col("price_after")
    return (
        sides.where(F.col("price_before").isNotNull() & F.col("price_after").isNotNull())
        .withColumn("price_ratio", ratio)
        .withColumn("status", F.when(ratio.between(low, high), "passed").otherwise("rejected"))
    )


def price_revision(
    old: DataFrame, new: DataFrame, old_policy: DataFrame, new_policy: DataFrame, min_rows: int = 20, tolerance: float = 0.02,
) -> DataFrame:
    """Median unexplained change between two versions of a price history; newly listed splits explain a rebase.

    A symbol absent from `old_policy` had no stored policy, so none of its splits count as new.
    """
    item = "array<struct<effective_date:date,ratio:double>>"
    fresh = new_policy.select("symbol", F.col("splits").alias("_new")).join(
        old_policy.select("symbol", F.col("splits").alias("_old")), "symbol", "left"
    ).select("symbol", F.array_except("_new", F.coalesce("_old", "_new")).alias("_actions"))
    pairs = (
        old.select("symbol", "date", F.col("close").alias("before"))
        .join(new.select("symbol", "date", F.col("close").alias("after")), ["symbol", "date"])
        .where((F.col("after") > 0) & (F.col("before") > 0))
        .join(fresh, "symbol", "left")
    )
    later = F.filter(F.coalesce("_actions", F.array().cast(item)), lambda s: s["effective_date"] > F.col("date"))
    expected = F.aggregate(later, F.lit(1.0), lambda product, s: product * s["ratio"])
    change = F.abs(F.col("before") / F.col("after") / expected - 1)
    return (
        pairs.withColumn("change", change).groupBy("symbol")
        .agg(F.count("change").alias("rows"), F.median("change").alias("median_change"))
        .withColumn("rejected", (F.col("rows") >= min_rows) & (F.col("median_change") > tolerance))
    )


def last_closed_session(calendar: DataFrame, now: Column) -> DataFrame:
    """The last session whose close is not after `now` (one row)."""
    return calendar.where(F.col("close_ts") <= now).agg(F.max("session_date").alias("closed"))


def session_lag(priced: DataFrame, calendar: DataFrame, now: Column) -> DataFrame:
    """Adds `lag_sessions`: sessions completed by `now` after `priced_on`."""
    # the days in question: completed sessions and pricing days, at most a few hundred a year
    done = calendar.where(F.col("close_ts") <= now).select(F.col("session_date").alias("_day"), F.lit(1).alias("_session"))
    asked = priced.select(F.col("priced_on").alias("_day"), F.lit(0).alias("_session")).distinct()
    later = W.orderBy(F.desc("_day")).rowsBetween(W.unboundedPreceding, -1)
    lags = (
        done.unionByName(asked).groupBy("_day").agg(F.max("_session").alias("_session"))
        .select(F.col("_day").alias("priced_on"), F.coalesce(F.sum("_session").over(later), F.lit(0)).alias("lag_sessions"))
    )
    return priced.join(lags, "priced_on", "left")


def valuation_summary(
    clean: DataFrame, states: DataFrame, policy: DataFrame, calendar: DataFrame, as_of, now: Column | None = None, selected: DataFrame | None = None,
) -> DataFrame:
    """One row per priced symbol: multiple, ranks, status and counters, or a reason why there is none.

    `states` (from `daily_states` over the valid prices) is read several times; give it as a written table. So is `selected`, the
    `selected_horizon` of the coverage windows: without it the windows are counted twice, here and for the history.
    """
    as_of = as_date(as_of)
    now = now if now is not None else F.date_add(as_of, 1).cast("timestamp")
    samples = states.where("state = 'valid'")
    latest = states.groupBy("symbol").agg(
        F.max_by(F.struct("date", "price", "state", "eps", "pe", "eps_filed_at", "eps_period_end"), "date").alias("now"),
        F.min(F.when(F.col("state") == "valid", F.col("date"))).alias("first_sample"),
        F.count_if(F.col("state").isin("missing_eps", "stale_eps")).alias("missing_earnings_days"),
        F.count_if(F.col("state") == "nonpositive_eps").alias("nonpositive_earnings_days"),
    ).select("symbol", "now.*", "first_sample", "missing_earnings_days", "nonpositive_earnings_days")
    selected = selected_horizon(coverage_windows(states, calendar, as_of)) if selected is None else selected
    history = samples_in_horizon(samples, selected).groupBy("symbol").agg(
        F.count("*").alias("sample_count"), F.min("date").alias("history_start"), F.max("date").alias("history_end"))
    broken = split_continuity(clean, policy, as_of).where("status = 'rejected'").select("symbol", F.lit(True).alias("broken")).distinct()
    known = policy.select("symbol", F.lit(True).alias("known"))
    rows = session_lag(
        latest.withColumnRenamed("date", "priced_on")
        .join(selected.drop("valuation_date"), "symbol", "left").join(history, "symbol", "left")
        .join(broken, "symbol", "left").join(known, "symbol", "left"),
        calendar, now,
    )
    reason = (
        F.when(F.col("known").isNull(), "policy_unknown").when(F.col("broken"), "split_discontinuity")
        .when(F.col("state") != "valid", "earnings_not_meaningful")
    )
    stale = F.col("lag_sessions") > 1
    ok = F.col("reason").isNull()
    status = (
        F.when(~ok, "rejected").when(stale, "stale").when(F.col("years") == max(HORIZONS), "qualified")
        .when(F.col("years").isNotNull(), "limited").otherwise("current_only")
    )

    def shown(column, condition=ok):
        return F.when(condition, F.col(column) if isinstance(column, str) else column)

    fresh = ok & ~stale
    return rows.withColumn("reason", reason).select(
        "symbol", F.lit(ALGORITHM_VERSION).alias("algorithm_version"), status.alias("status"), "reason",
        (ok & ~stale).alias("current_pe_qualified"), F.lit("daily").alias("frequency"),
        F.col("priced_on").alias("as_of"), "price", shown("pe").alias("pe"), shown("eps").alias("eps_ttm"),
        shown("eps_filed_at").alias("eps_filed_at"), shown("eps_period_end").alias("eps_period_end"),
        shown("years").alias("horizon_years"), shown("percentile", fresh).alias("percentile"),
        shown("percentile10y", fresh).alias("percentile10y"), shown("sample_count").alias("sample_count"),
        shown("history_start").alias("history_start"), shown("history_end").alias("history_end"),
        shown(F.lit(100.0) / F.col("pe")).alias("earnings_yield_percent"), "lag_sessions",
        shown(S.half_up(F.datediff("priced_on", "first_sample") / F.lit(365.25), 2)).alias("coverage_years"),
        "missing_earnings_days", "nonpositive_earnings_days",
    )


def publish_gate(valuation: DataFrame, calendar: DataFrame, now: Column) -> DataFrame:
    """Withdraw other algorithm versions, of which only date, status and reason stay; mark late prices or old earnings stale,
    which keep the multiple but no rank. Reference prices go through `published_references`. A valuation without the
    column `reason` gets one, null where nothing is withdrawn."""
    if "reason" not in valuation.columns:
        valuation = valuation.withColumn("reason", F.lit(None).cast("string"))
    rows = session_lag(valuation.drop("lag_sessions").withColumn("priced_on", F.col("as_of")), calendar, now)
    other = F.coalesce(F.col("algorithm_version") != ALGORITHM_VERSION, F.lit(True))
    age = F.datediff(now.cast("date"), "eps_period_end")
    late = F.coalesce(F.col("current_pe_qualified") & ((F.col("lag_sessions") > 1) | (age > STALE_DAYS)), F.lit(False))
    hidden = other | late
    gated = {
        "status": F.when(other, "withdrawn").when(late, "stale").otherwise(F.col("status")),
        "reason": F.when(other, "other_version").when(late, "stale_inputs").otherwise(F.col("reason")),
        "current_pe_qualified": ~hidden & F.col("current_pe_qualified"),
        "percentile": F.when(~hidden, F.col("percentile")),
        "percentile10y": F.when(~hidden, F.col("percentile10y")),
        "sample_count": F.when(other, F.lit(0)).otherwise(F.col("sample_count")),
        "algorithm_version": F.lit(ALGORITHM_VERSION),
    }
    kept = {"symbol", "as_of", *gated}
    return rows.drop("priced_on").withColumns({**{c: F.when(~other, F.col(c)) for c in valuation.columns if c not in kept and c != "lag_sessions"}, **gated})


def published_references(references: DataFrame, gated: DataFrame) -> DataFrame:
    """Reference prices of symbols whose gated valuation is neither withdrawn nor stale."""
    open_ = gated.where(~F.col("status").isin("withdrawn", "stale")).select("symbol")
    return references.join(open_, "symbol", "left_semi")


def eligible_percentile() -> Column:
    """The percentile when it may drive a judgement, else null."""
    usable = (
        (F.col("algorithm_version") == ALGORITHM_VERSION) & F.col("current_pe_qualified")
        & F.col("status").isin("qualified", "limited") & (F.col("frequency") == "daily") & S.finite(F.col("percentile"))
    )
    return F.when(usable, F.col("percentile"))


def annual_percentile(samples: DataFrame, observed, years: int = 10) -> DataFrame:
    """Rank on year-end samples; `complete` tells whether every one of the last ten years is present."""
    observed = as_date(observed)
    ranked = pe_percentile(samples, observed, years)
    day, pe = S.safe_date(F.col("date").cast("string")), F.col("pe").cast("double")
    good = day.between(S.years_before(observed, years), observed) & S.finite(pe) & (pe > 0)
    wanted = F.year(day).between(F.year(observed) - years, F.year(observed) - 1)
    found = samples.where(good & wanted).groupBy("symbol").agg(F.count_distinct(F.year(day)).alias("years_found"))
    return ranked.join(found, "symbol", "left").withColumns({
        "years_found": F.coalesce("years_found", F.lit(0)),
        "complete": F.coalesce(F.col("years_found"), F.lit(0)) == years, "frequency": F.lit("annual"),
    })


def suspend_on_new_filing(valuation: DataFrame, pending: DataFrame) -> DataFrame:
    """Null the ranks where a newer report is pending or the snapshot is ahead of the earnings (`pending`, `period_end`)."""
    rows = valuation.join(pending.select("symbol", "pending", F.col("period_end").alias("_end")), "symbol", "left")
    ahead = F.coalesce(F.col("pending"), F.lit(False)) | F.coalesce(F.col("_end") > F.col("eps_period_end"), F.lit(False))
    stop = F.coalesce(F.col("current_pe_qualified"), F.lit(False)) & ahead
    return rows.withColumns({
        "status": F.when(stop, "incomplete").otherwise(F.col("status")),
        "current_pe_qualified": ~stop & F.col("current_pe_qualified"),
        "percentile": F.when(~stop, F.col("percentile")), "percentile10y": F.when(~stop, F.col("percentile10y")),
    }).drop("pending", "_end")
