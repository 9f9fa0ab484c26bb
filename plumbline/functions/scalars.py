"""Column functions: cleaning, dates, ratios and small text rules. Everything is a native expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.schemas import FORMS

# Month names and abbreviations of the date grammar.
MONTHS = {
    1: ("january", "jan"), 2: ("february", "feb"), 3: ("march", "mar"), 4: ("april", "apr"), 5: ("may",),
    6: ("june", "jun"), 7: ("july", "jul"), 8: ("august", "aug"), 9: ("september", "sept", "sep"),
    10: ("october", "oct"), 11: ("november", "nov"), 12: ("december", "dec"),
}
MONTH_WORDS = "|".join(sorted((word for words in MONTHS.values() for word in words), key=len, reverse=True))
TEXT_DATE = rf"(?i)\b({MONTH_WORDS})\.?\s+(\d{{1,2}})\s*,?\s+((?:19|20)\d{{2}})\b"
# Words that mean "no number", and the legal suffix a short name drops.
BLANK_NUMBERS = ("n/a", "na", "none", "unch")
LEGAL_SUFFIX = r"(?is),?\s+(Inc\.?|Corp\.?|Corporation|Ltd\.?).*$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def finite(value: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    value = value.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite_or_null(value: Column) -> Column:
    return F.when(finite(value), value.cast("double"))


def half_up(value: Column, digits: int) -> Column:
    """Round half toward plus infinity; the arithmetic is spelled out so every engine gives the same bits."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def parse_number(text: Column) -> Column:
    text = F.trim(text)
    return finite_or_null(F.when(text.rlike(NUMBER), text.try_cast("double")))


def clean_number(value: Column) -> Column:
    """Provider number: strips `, $ %`; blanks, not-available words and non-finite values become null."""
    text = F.regexp_replace(F.trim(value.cast("string")), r"[,$%]", "")
    return F.when(~F.lower(text).isin(*BLANK_NUMBERS), parse_number(text))


def accounting_number(value: Column) -> Column:
    """Report number: parentheses and U+2212 mean negative; the whole cell must be one number."""
    text = F.trim(F.translate(value, "−$,", "-"))
    digits = F.regexp_replace(text, r"[()]", "").try_cast("double")
    return F.when(
        text.rlike(r"^\(?-?\d+(\.\d+)?\)?$"),
        F.when(text.startswith("("), -F.abs(digits)).otherwise(digits),
    )


def safe_date(value: Column) -> Column:
    """Strict `yyyy-MM-dd`; anything else is null, never an error."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))


def safe_utc_timestamp(value: Column) -> Column:
    """ISO timestamp; a missing zone means UTC (the session zone)."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), value.try_cast("timestamp"))


def date_from_format(value: Column, fmt: str) -> Column:
    return F.try_to_timestamp(value, F.lit(fmt)).cast("date")


def month_number(word: Column) -> Column:
    """1 to 12 for a month's name or abbreviation, else null: one look-up in a literal map."""
    pairs = [F.lit(x) for number, words in MONTHS.items() for w in words for x in (w, number)]
    return F.try_element_at(F.create_map(*pairs), F.lower(word))


def text_dates(text: Column) -> Column:
    """All `Month d, yyyy` dates of a text, in order; impossible days are dropped."""

    def to_date(match: Column) -> Column:
        parts = F.split(F.trim(F.regexp_replace(match, r"[^a-zA-Z0-9]+", " ")), " ")
        return F.concat_ws(
            "-", F.get(parts, 2), F.lpad(month_number(F.get(parts, 0)).cast("string"), 2, "0"), F.lpad(F.get(parts, 1), 2, "0"),
        ).try_cast("date")

    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(TEXT_DATE), F.lit(0)), to_date))


def names_date(text: Column, day: Column) -> Column:
    """Whether a text names one day in the grammar of `text_dates`: a search for that day's spellings, not a list of all dates."""
    words = F.element_at(F.array(*[F.lit("|".join(MONTHS[m])) for m in range(1, 13)]), F.month(day))
    spelled = F.concat(
        F.lit(r"(?i)\b(?:"), words, F.lit(r")\.?\s+0?"), F.dayofmonth(day).cast("string"), F.lit(r"\s*,?\s+"), F.year(day).cast("string"), F.lit(r"\b"))
    return F.regexp_like(text, spelled) & F.year(day).between(1900, 2099)


def years_before(day: Column, years: int | Column) -> Column:
    """Same day some years earlier; 29 February falls back to the 28th."""
    months = F.lit(-12 * years) if isinstance(years, int) else (years * F.lit(-12)).cast("int")
    return F.add_months(day, months)


def target_month(end: Column, years: Column) -> Column:
    return F.add_months(end, (years * F.lit(12)).cast("int"))


def period_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def accepted_span(days: Column) -> Column:
    return days.between(50, 400)


def quarter_span(days: Column) -> Column:
    return days.between(60, 110)


def annual_span(days: Column) -> Column:
    return days.between(330, 400)


def span_class(days: Column) -> Column:
    return (
        F.when(quarter_span(days), F.lit("quarter"))
        .when(annual_span(days), F.lit("annual"))
        .when(accepted_span(days), F.lit("ytd"))
    )


def base_form(form: Column) -> Column:
    return F.regexp_replace(F.coalesce(form, F.lit("")), r"/A$", "")


def accepted_form(form: Column) -> Column:
    return base_form(form).isin(*FORMS)


def free_cash_flow(cash: Column, capex: Column) -> Column:
    return cash - capex


def percent_change(current: Column, previous: Column) -> Column:
    return F.when(previous > 0, half_up(F.lit(100.0) * (current / previous - F.lit(1.0)), 2))


def positive_ratio(numerator: Column, denominator: Column, scale: float = 100.0) -> Column:
    usable = finite(numerator) & finite(denominator) & (denominator > 0)
    return F.when(usable, numerator / denominator * F.lit(scale))


def marginal_coverage(cash_delta: Column, capex_delta: Column) -> Column:
    return F.when(capex_delta > 0, half_up(cash_delta / capex_delta, 4))


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat(
        F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.try_cast("bigint").cast("string"), F.lit("/"),
        F.translate(accession, "-", ""), F.lit("/"), document,
    )


def content_hash(*columns: str) -> Column:
    """Fingerprint of the named columns in sorted order; equal content gives an equal hash."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def valid_symbol(value: Column) -> Column:
    """Normalised ticker, or null when it is not one."""
    symbol = F.upper(F.trim(value))
    return F.when(symbol.rlike(r"^[A-Z][A-Z0-9.-]{0,9}$"), symbol)


def error_summary(**stages: Column) -> Column:
    """`stage: error` parts of the non-empty errors joined by `; `; null when there is none."""
    parts = [
        F.when(error.isNotNull() & (error != ""), F.concat(F.lit(f"{stage}: "), error)) for stage, error in stages.items()
    ]
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))


def short_name(name: Column, length: int | None = None) -> Column:
    """Name without its legal suffix, cut only where a length is given."""
    short = F.regexp_replace(name, LEGAL_SUFFIX, "")
    return short if length is None else F.substring(short, 1, length)


def override(user: Column, automatic: Column) -> Column:
    """User text over an automatic value: null keeps the automatic one, blank means missing."""
    return F.when(user.isNull(), automatic).when(F.trim(user) == "", F.lit(None).cast("double")).otherwise(parse_number(user))


def allowed_host(url: Column, hosts: tuple[str, ...]) -> Column:
    """True when the URL's host is on the list; a malformed URL is not."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*hosts), F.lit(False))


def truncate_components(df, *heavy: str):
    """Publish-time view without history and timeline columns."""
    return df.drop(*(heavy or ("history", "earnings_timeline")))
