"""Audits: independent recomputation, content checks and publication scans. Findings are rows, nothing is raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators.matching import dealt, order_statistics

TOLERANCE = 1e-10

# Credential patterns, forbidden path parts and suffixes, size limit in bytes, and image signatures.
SECRET_PATTERNS = (
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"\bgh[pousr]_[A-Za-z0-9]{30,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{40,}\b",
    r"\bsk-[A-Za-z0-9_-]{32,}\b",
    r"\bAKIA[A-Z0-9]{16}\b",
    r"\beyJ[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}\b",
)
FORBIDDEN_PATHS = (
    r"(^|/)(node_modules|\.venv|__pycache__|logs|dist)(/|$)", r"^data/", r"^research/",
    r"(^|/)\.env(?!\.example$)[^/]*$", r"(?i)\.(pem|key|token|db|pyc)$",
)
SIZE_LIMIT = 50 * 1024 * 1024


def relative_gap(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """True when two numbers differ by more than a relative tolerance."""
    return F.abs(a - b) > F.greatest(F.abs(a), F.abs(b)) * F.lit(tolerance)


def audit_components(components: DataFrame, facts: DataFrame, tasks: int | None = None) -> DataFrame:
    """Violations (symbol, event, check, n) of the rules a four-quarter sum must keep.

    `components` has one row per quarter: symbol, event_id, observed (a date), start, end, filed_at, reported_eps,
    split_adjustment, eps, accession. Every quarter must match an original fact on five keys. `tasks`: how many tasks the rows
    are dealt to, where the caller knows the size of the input.
    """
    keys = ["symbol", "event_id"]
    # a number as its text, zero without sign: Spark deals texts as they are, but brings numbers into one form before it joins them
    match = ["symbol", "start", "end", "filed_at", "accession", "_value"]
    order = W.partitionBy(*keys).orderBy("end")
    source = facts.select(
        "symbol", F.col("start").alias("start"), F.col("end").alias("end"), F.col("filed").alias("filed_at"),
        F.col("accn").alias("accession"), (F.col("val") + 0.0).cast("string").alias("_value"))
    source = dealt(source, tasks, *match).distinct().withColumn("_found", F.lit(True))
    components = components.withColumn("_value", (F.col("reported_eps") + 0.0).cast("string"))
    rows = dealt(dealt(components, tasks, *match).join(source, match, "left"), tasks, *keys)
    rows = rows.withColumn("_previous", F.lag("end").over(order))
    adjusted = F.try_divide("reported_eps", "split_adjustment")
    checks = {
        "span": ~S.quarter_span(F.datediff("end", "start")),
        "availability": F.col("filed_at") >= F.col("observed"),
        "future_period": F.col("end") >= F.col("observed"),
        "bad_factor": ~(S.finite(F.col("split_adjustment")) & (F.col("split_adjustment") > 0)),
        "adjusted_mismatch": relative_gap(F.col("eps"), adjusted) & (F.abs(F.col("eps") - adjusted) > TOLERANCE),
        "boundary_gap": F.col("_previous").isNotNull() & (F.datediff("start", "_previous") != 1),
        "unmatched_source": F.col("_found").isNull(),
    }
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("start").alias("_first"), F.max("end").alias("_last"),
        *[F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in checks.items()],
    )
    listed = F.array(
        F.struct(F.lit("count").alias("check"), (F.col("_n") != 4).cast("long").alias("n")),
        F.struct(F.lit("year_span").alias("check"), (~S.annual_span(F.datediff("_last", "_first"))).cast("long").alias("n")),
        *[F.struct(F.lit(name).alias("check"), F.col(name).alias("n")) for name in checks],
    )
    return counts.select(*keys, F.inline(F.filter(listed, lambda c: c["n"] > 0)))


def rebuild_samples(prices: DataFrame, timeline: DataFrame, calendar: DataFrame, tasks: int | None = None) -> DataFrame:
    """Samples rebuilt with a plan of its own: events as validity intervals cut into months, equi-joined with sessions.

    Only prices on calendar sessions count. `tasks`: how many tasks both sides are dealt to, where the caller knows their size.
    """
    order = W.partitionBy("symbol").orderBy("available_on")
    events = dealt(timeline.select("symbol", "available_on", "eps", "filed_at", "period_end"), tasks, "symbol")
    intervals = events.withColumn("until", F.lead("available_on").over(order))
    # an event is stale 160 days after its period end, so its interval never needs to reach further
    last = F.least(F.coalesce(F.date_sub("until", 1), F.date_add("period_end", 160)), F.date_add("period_end", 160))
    live = intervals.where(F.col("eps").isNotNull()).withColumn("last", last).where(F.col("last") >= F.col("available_on"))
    months = F.sequence(F.trunc("available_on", "MM"), F.trunc("last", "MM"), F.expr("INTERVAL 1 MONTH"))
    live = live.withColumn("month", F.explode(months))
    sessions = prices.join(calendar.select(F.col("session_date").alias("date")), "date", "left_semi").withColumn("month", F.trunc("date", "MM"))
    return (
        dealt(sessions, tasks, "symbol", "month").join(dealt(live, tasks, "symbol", "month"), ["symbol", "month"]).where(F.col("date").between(F.col("available_on"), F.col("last")))
        .select("symbol", "date", F.col("close").alias("price"), "eps", F.when(F.col("eps") > 0, F.col("close") / F.col("eps")).alias("pe"),
                F.col("filed_at").alias("eps_filed_at"), F.col("period_end").alias("eps_period_end"))
    )


def reconcile_samples(published: DataFrame, rebuilt: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Differences (symbol, date, issue) between two sample sets; none when they agree."""
    keys = ["symbol", "date"]
    names = ("price", "pe", "eps", "eps_filed_at", "eps_period_end")

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*keys, F.lit(True).alias(f"{tag}_in"), *[F.col(n).alias(f"{tag}_{n}") for n in names])

    rows = side(published, "a").join(side(rebuilt.where("pe IS NOT NULL"), "b"), keys, "full")
    issue = (
        F.when(F.col("a_in").isNull(), "not_published").when(F.col("b_in").isNull(), "not_rebuilt")
        .when(F.col("a_price") != F.col("b_price"), "price")
        .when(relative_gap(F.col("a_pe"), F.col("b_pe"), tolerance), "pe").when(relative_gap(F.col("a_eps"), F.col("b_eps"), tolerance), "eps")
        .when((F.col("a_eps_filed_at") != F.col("b_eps_filed_at")) | (F.col("a_eps_period_end") != F.col("b_eps_period_end")), "wrong_event")
    )
    return rows.select(*keys, issue.alias("issue")).where("issue IS NOT NULL")


def audit_valuation(summary: DataFrame, rebuilt: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """Recount of rank, sample count and P20, P50 and P80 over the rebuilt samples of each eligible symbol's window.

    The quantiles are recounted by ranks over ranges, a plan of its own. With `published` (symbol, percentile, pe) the column
    `quantiles_match` tells whether all three agree; it is null where none are published.
    """
    eligible = summary.where(F.col("status").isin("qualified", "limited") & F.col("current_pe_qualified"))
    window = eligible.select("symbol", F.col("as_of"), "horizon_years", F.col("pe").alias("now_pe"), "percentile", "sample_count")
    inside = rebuilt.where("pe IS NOT NULL").join(window, "symbol").where(
        (F.col("date") >= S.years_before(F.col("as_of"), F.col("horizon_years"))) & (F.col("date") <= F.col("as_of")))
    counted = inside.groupBy("symbol", "horizon_years", "percentile", "sample_count", "now_pe").agg(
        F.count("*").alias("recounted_samples"),
        S.half_up(F.lit(100.0) * F.count_if(F.col("pe") <= F.col("now_pe")) / F.count("*"), 2).alias("recounted_percentile"),
    )
    points = order_statistics(inside.select("symbol", "pe"), ["symbol"], "pe", (20, 50, 80))
    match = F.lit(None).cast("boolean")
    if published is not None:
        points = points.join(published.select("symbol", "percentile", F.col("pe").alias("_published")), ["symbol", "percentile"], "left")
        match = F.when(F.count("_published") > 0, F.count_if(~F.coalesce(relative_gap(F.col("pe"), F.col("_published")), F.lit(True))) == 3)
    named = points.groupBy("symbol").agg(
        *(F.max(F.when(F.col("percentile") == p, F.col("pe"))).alias(name) for p, name in ((20, "p20_pe"), (50, "median_pe"), (80, "p80_pe"))),
        match.alias("quantiles_match"))
    return counted.join(named, "symbol").select(
        "symbol", "horizon_years", "recounted_samples", "recounted_percentile", "p20_pe", "median_pe", "p80_pe",
        (F.col("recounted_percentile") == F.col("percentile")).alias("percentile_matches"),
        (F.col("recounted_samples") == F.col("sample_count")).alias("count_matches"), "quantiles_match")


def audit_checkpoints(facts: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Hand-read values (symbol, end, expected) that no original fact carries exactly."""
    found = facts.select("symbol", "end", F.col("val").alias("expected")).distinct()
    return checkpoints.join(found, ["symbol", "end", "expected"], "left_anti")


def opening(name: str, doctype: str) -> str:
    """A markup document whose first element has this name, after a byte order mark, declarations and comments of any length."""
    return rf"(?is)^(?:\u00ef\u00bb\u00bf)?\s*(?:<\?xml.*?\?>\s*|<!--.*?-->\s*|<!doctype\s+{doctype}[^>]*>\s*)*<{name}[\s>]"


def image_signature_ok(name: Column, content: Column) -> Column:
    """Whether the leading bytes fit the file suffix; null for a suffix without a known signature."""
    head = F.hex(F.substring(content, 1, 12))
    suffix = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))
    return (
        F.when(suffix == ".png", head.startswith("89504E470D0A1A0A"))
        .when(suffix.isin(".jpg", ".jpeg"), head.startswith("FFD8FF"))
        .when(suffix == ".gif", head.startswith("474946383761") | head.startswith("474946383961"))
        .when(suffix == ".webp", head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe("57454250"))
        .when(suffix == ".bmp", head.startswith("424D"))
        .when(suffix == ".svg", F.decode(content, "ISO-8859-1").rlike(opening("svg", "svg")))
        .when(suffix == ".avif", F.substring(head, 9, 16).isin("6674797061766966", "6674797061766973"))
    )


def verify_content(manifest: DataFrame, content: DataFrame) -> DataFrame:
    """Issue rows (item, issue) of a manifest (item, bytes, sha256) against content (item, content binary).

    A second hash basis with LF line endings is accepted for text; `hash_by_text_basis` reports that it was needed.
    Hashes, sizes and signatures are computed where the content is read, so the join moves only these, never the bytes.
    """
    text = F.decode("content", "ISO-8859-1")  # one character per byte, so no byte is lost or refused
    lf = F.encode(F.regexp_replace(text, "\r\n", "\n"), "ISO-8859-1")
    is_page = F.col("item").rlike(r"(?i)\.html?$")
    actual = content.select(
        "item", F.lit(True).alias("_there"), F.octet_length("content").alias("_bytes"), F.sha2("content", 256).alias("_hash"),
        F.when(is_page, F.sha2(lf, 256)).alias("_text_hash"), image_signature_ok(F.col("item"), F.col("content")).alias("_signature"),
        text.rlike(r"(?i)<!doctype\s+html|<html[\s>]").alias("_looks_html"), (is_page & ~F.is_valid_utf8(F.col("content").cast("string"))).alias("_bad_text"),
    )
    rows = manifest.withColumn("_listed", F.lit(True)).join(actual, "item", "full")
    listed = F.col("_listed") & F.col("_there")
    exact = F.col("_hash") == F.col("sha256")
    by_text = F.coalesce(F.col("_text_hash") == F.col("sha256"), F.lit(False))
    checks = [
        ("unlisted", F.col("_listed").isNull()), ("missing", F.col("_there").isNull()),
        ("byte_count", listed & (F.col("_bytes") != F.col("bytes"))),
        ("sha256", listed & ~exact & ~by_text), ("hash_by_text_basis", listed & ~exact & by_text),
        ("bad_signature", listed & (F.col("_signature") == F.lit(False))),
        ("bad_encoding", listed & F.col("_bad_text")),
        ("html_as_image", listed & F.col("_signature").isNotNull() & F.col("_looks_html")),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks]))
    return rows.select("item", F.explode(found).alias("issue"))


def scan_sensitive(
    documents: DataFrame, path: str, text: str, size: str, patterns: tuple[str, ...] = SECRET_PATTERNS, brands: tuple[str, ...] = (),
    size_limit: int = SIZE_LIMIT,
) -> DataFrame:
    """Issue rows (path, issue) per document; where, never what. The whole text is searched.

    Patterns are a short list given by the caller, so they are literals of one row-wise expression and nothing shuffles.
    """

    def any_match(column: Column, expressions) -> Column:
        found = F.lit(False)
        for expression in expressions:
            found = found | column.rlike(expression)
        return found

    name, body = F.col(path).cast("string"), F.col(text)
    words = [rf"(?i)(?<![A-Za-z])\Q{term}\E(?![A-Za-z])" for term in brands]
    checks = [
        ("forbidden_path", any_match(name, FORBIDDEN_PATHS)), ("size", F.col(size) > size_limit),
        ("brand_in_path", any_match(name, words)), ("brand_in_text", any_match(body, words)),
        ("credential", any_match(body, patterns)),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(issue)) for issue, bad in checks]))
    return documents.select(name.alias("path"), F.explode(found).alias("issue"))


def corpus_totals(items: DataFrame, issues: DataFrame) -> DataFrame:
    """One row of totals: items, images, bytes and issues."""
    counted = items.agg(F.count("*").alias("items"), F.sum("images").alias("images"), F.sum("bytes").alias("bytes"), F.lit(0).cast("long").alias("issues"))
    found = issues.agg(F.lit(0).cast("long").alias("items"), F.lit(0).cast("long").alias("images"), F.lit(0).cast("long").alias("bytes"), F.count("*").alias("issues"))
    return counted.unionByName(found).agg(*[F.sum(c).alias(c) for c in ("items", "images", "bytes", "issues")])
