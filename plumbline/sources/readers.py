"""Sources. Each `read_*` reads files with an explicit schema; the matching `parse_*` works on any DataFrame."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.functions import scalars as S
from plumbline.operators.matching import keep_latest

BAD = "_bad"
TREE = {"recursiveFileLookup": "true"}  # all files below a path, whatever its folders are called
MARKS = re.compile(r"([\[\]{}*?\\])")  # what makes a path a pattern


def file_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(path, per_line): whether most lines of a file that are not blank hold a JSON object each. One scan that splits files."""
    lines = spark.read.options(**TREE).text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line")).where("line <> ''")
    whole = F.startswith("line", F.lit("{")) & F.endswith("line", F.lit("}"))
    return lines.groupBy("path").agg((F.count_if(whole) * 2 >= F.count(F.lit(1))).alias("per_line"))


def layout_paths(spark: SparkSession, path: str) -> dict[bool, list[str]]:
    """The paths to read as lines (True) and as documents (False): `path` itself where all files below it are of one kind, else
    the highest folders of one kind and the single files of folders that hold both. The driver gets these, not every file."""
    files = file_layouts(spark, path).persist()
    try:
        every, some = files.agg(F.every("per_line"), F.some("per_line")).first()
        if every is None or every == some:
            return {True: [path], False: []} if every is None or every else {True: [], False: [path]}
        rows = files
        if not MARKS.search(path):  # the files that a pattern names may stand beside others, so its folders are not read whole
            base = spark._jvm.org.apache.hadoop.fs.Path(path)
            depth = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/").count("/")
            parts = F.split("path", "/")
            head = F.size(parts) - F.size(F.split(F.regexp_replace("path", "^[^:/]+:(//[^/]*)?", ""), "/"))
            above = F.transform(F.sequence(head + (depth + 1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
            folders = files.select(F.explode(above).alias("path"), "per_line").groupBy("path").agg(F.every("per_line").alias("every"), F.some("per_line").alias("some"))
            mixed = folders.where("every <> some").select(F.col("path").alias("folder"))
            whole = folders.where("every = some").select("path", F.col("every").alias("per_line")).unionByName(files)
            rows = whole.join(mixed, F.regexp_replace("path", "/[^/]*$", "") == F.col("folder"), "left_semi")
        paths = {True: [], False: []}
        for row in rows.collect():
            # the listing gives names as URLs, and Spark takes marks in a name for a pattern
            paths[row["per_line"]].append(MARKS.sub(r"\\\1", unquote(row["path"])))
        return paths
    finally:
        files.unpersist()


def json_documents(spark: SparkSession, path: str, schema: T.StructType, layout: str | None = None) -> DataFrame:
    """(path, d, bad): the JSON documents of text files as structs, or the text of a record that does not parse, with null `d`.

    `lines`: one document per line; files are split, a bad line is one bad record. `documents`: a file holds one document, or a
    list of them, printed over many lines; it is parsed as a stream, a bad file is one bad record. Without a layout each file is
    told by `file_layouts`, and folders of one kind are read as folders (`layout_paths`); files are not to be added meanwhile.
    Blank lines are skipped.
    """
    fields = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    name = F.col("_metadata.file_path").alias("path")

    def split(paths) -> DataFrame:
        lines = spark.read.options(**TREE).text(paths).select(name, "value").where(F.trim("value") != "")
        return lines.select("path", F.from_json("value", fields, options).alias("d")).select("path", "d", F.col(f"d.{BAD}").alias("bad"))

    def streamed(paths) -> DataFrame:
        # Spark refuses to read the bad record alone; the empty piece of another column keeps that one in the scan
        other = F.substring(F.coalesce(F.col(schema.fieldNames()[0]).cast("string"), F.lit("")), 1, 0)
        files = spark.read.schema(fields).options(multiLine=True, **options, **TREE).json(paths)
        return files.select(name, F.struct(*fields.fieldNames()).alias("d"), F.concat(F.col(BAD), other).alias("bad"))

    if layout is not None:
        found = {"lines": split, "documents": streamed}[layout](path)
    else:
        paths = layout_paths(spark, path)
        parts = [read(paths[kind]) for kind, read in ((True, split), (False, streamed)) if paths[kind]]
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.select("path", F.when(F.col("bad").isNull(), F.col("d").dropFields(BAD)).alias("d"), "bad")


def bad_records(documents: DataFrame) -> DataFrame:
    """(path, bad): what did not parse; to be written beside the good rows."""
    return documents.where("bad IS NOT NULL").select("path", "bad")


def good(documents: DataFrame) -> DataFrame:
    return documents.where("bad IS NULL").select("path", "d.*")


def parse_company_facts(documents: DataFrame) -> DataFrame:
    """(symbol, facts map) rows to flat fact rows; values that do not parse become null, never an error."""
    # the maps are flattened inside the row and leave it by one generator, so no parent is copied on the way
    flat = F.flatten(F.transform(F.map_entries("facts"), lambda taxonomy: F.flatten(F.transform(F.map_entries(taxonomy["value"]), lambda concept: F.flatten(
        F.transform(F.map_entries(concept["value"]["units"]), lambda unit: F.transform(unit["value"], lambda item, pos: F.struct(
            taxonomy["key"].alias("taxonomy"), concept["key"].alias("concept"), unit["key"].alias("unit"), pos.alias("pos"), item.alias("item")))))))))
    items = documents.select("symbol", F.inline(flat))
    return items.select(
        "symbol", "taxonomy", "concept", "unit", S.safe_date(F.col("item.start")).alias("start"),
        S.safe_date(F.col("item.end")).alias("end"), S.safe_date(F.col("item.filed")).alias("filed"), F.col("item.form").alias("form"),
        F.col("item.accn").alias("accn"), S.parse_number(F.col("item.val")).alias("val"), F.col("pos").cast("long").alias("pos"),
        (F.col("item.start").isNotNull() & (F.col("item.start") != "")).alias("has_start"),
    ).where("has_start = false OR start IS NOT NULL").drop("has_start")


def company_facts(documents: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Facts of `json_documents` of the schema FACTS_DOCUMENT. The provider's documents name a company by `cik`; `symbols` (cik,
    symbol) gives its symbols, and documents of unknown companies keep a null symbol."""
    rows = good(documents)
    if symbols is not None:
        known = symbols.select(F.lpad("cik", 10, "0").alias("_cik"), F.col("symbol").alias("_symbol")).distinct()
        rows = rows.join(known, F.lpad("cik", 10, "0") == F.col("_cik"), "left").withColumn("symbol", F.coalesce("symbol", "_symbol"))
    return parse_company_facts(rows.select("symbol", "facts"))


def read_company_facts(spark: SparkSession, path: str, symbols: DataFrame | None = None, layout: str | None = None) -> DataFrame:
    return company_facts(json_documents(spark, path, schemas.FACTS_DOCUMENT, layout), symbols)


def facts_from_json(texts: DataFrame, column: str = "document") -> DataFrame:
    return parse_company_facts(texts.select(F.from_json(column, schemas.FACTS_DOCUMENT).alias("d")).select("d.*"))


def parse_prices(rows: DataFrame) -> DataFrame:
    """`MM/dd/yyyy` dates and currency text; the last row per symbol and date wins."""
    typed = rows.select(
        "symbol", S.date_from_format(F.col("date"), "MM/dd/yyyy").alias("date"), S.clean_number(F.col("close")).alias("close"), "pos"
    ).where(F.col("date").isNotNull() & F.col("close").isNotNull())
    return typed.groupBy("symbol", "date").agg(F.max_by("close", "pos").alias("close"))


PRICE_DOCUMENT = T.StructType([
    *schemas.PRICE_ROW.fields,
    T.StructField("data", T.StructType([T.StructField("symbol", T.StringType()), T.StructField("tradesTable", T.StructType([
        T.StructField("rows", T.ArrayType(T.StructType([T.StructField("date", T.StringType()), T.StructField("close", T.StringType())])))]))])),
])


def read_prices(spark: SparkSession, path: str, layout: str | None = None) -> DataFrame:
    """Price files: flat rows, or the provider's response, whose rows lie under `data.tradesTable.rows` and whose symbol is
    `data.symbol` or, without one, the file name's last part (`prices-KOLB.json`)."""
    documents = good(json_documents(spark, path, PRICE_DOCUMENT, layout))
    flat = documents.where("data IS NULL").select("symbol", "date", "close", "pos")
    named = F.coalesce("data.symbol", F.regexp_extract("path", r"([A-Za-z0-9.]+)\.json$", 1))
    nested = documents.where("data IS NOT NULL").select(F.upper(named).alias("symbol"), F.posexplode("data.tradesTable.rows").alias("pos", "r"))
    return parse_prices(flat.unionByName(nested.select("symbol", "r.date", "r.close", F.col("pos").cast("long").alias("pos"))))


def quote_items(payload: Column) -> Column:
    """An array of quotes from text that holds an array, one object, or the provider's outer result object with either."""
    outer = F.get_json_object(payload, "$.FormattedQuoteResult.FormattedQuote")
    text = F.trim(F.coalesce(outer, payload))
    array = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return F.from_json(array, T.ArrayType(schemas.QUOTE_ITEM))


def parse_quotes(payloads: DataFrame) -> DataFrame:
    """(captured_at, quotes text) rows to typed quotes; works on batch and streaming input."""
    items = payloads.select(S.safe_utc_timestamp(F.col("captured_at")).alias("captured_at"), F.inline(quote_items(F.col("quotes"))))
    number = {n: S.clean_number(F.col(n)) for n in ("open", "high", "low")}
    return items.withColumns({
        "symbol": F.upper("symbol"), "price": S.clean_number(F.col("last")), "change_percent": S.clean_number(F.col("change_pct")),
        "volume": S.clean_number(F.col("volume")).cast("long"), **number,
        "as_of": F.coalesce("last_timedate", "last_time", F.col("captured_at").cast("string")),
    }).select("symbol", "captured_at", "price", "change_percent", "open", "high", "low", "volume", "as_of")


def read_quotes(spark: SparkSession, path: str, layout: str | None = None) -> DataFrame:
    return parse_quotes(good(json_documents(spark, path, schemas.QUOTE_PAYLOAD, layout)))


def stream_quotes(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    source = spark.readStream.schema(schemas.QUOTE_PAYLOAD).option("maxFilesPerTrigger", files_per_trigger)
    return parse_quotes(source.json(path))


def parse_filings(payloads: DataFrame) -> DataFrame:
    """(symbol, cik, parallel arrays) rows to filing rows; short arrays are padded with empty text."""
    zipped = F.arrays_zip(*[F.col(name) for name in schemas.FILING_FIELDS])
    rows = payloads.select("symbol", "cik", F.inline(F.slice(zipped, F.lit(1), F.coalesce(F.size("form"), F.lit(0)))))
    text = {name: F.coalesce(F.col(name), F.lit("")) for name in schemas.FILING_FIELDS}
    return rows.select(
        "symbol", "cik", text["accessionNumber"].alias("accession"), text["form"].alias("form"),
        S.safe_date(text["filingDate"]).alias("filed"), S.safe_date(text["reportDate"]).alias("report_date"),
        text["primaryDocument"].alias("document"), text["items"].alias("items"),
    )


FILING_PAYLOAD = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("cik", T.StringType()), *schemas.FILING_ARRAYS.fields])


SUBMISSION = T.StructType([
    *FILING_PAYLOAD.fields, T.StructField("tickers", T.ArrayType(T.StringType())),
    T.StructField("filings", T.StructType([T.StructField("recent", schemas.FILING_ARRAYS)])),
])


def filing_payloads(spark: SparkSession, path: str, layout: str | None = None) -> DataFrame:
    """(symbol, cik, parallel arrays) of flat documents or of the provider's, which nest the arrays under `filings.recent` and
    list the company's tickers."""
    d = good(json_documents(spark, path, SUBMISSION, layout))
    arrays = [F.coalesce(name, F.col(f"filings.recent.{name}")).alias(name) for name in schemas.FILING_FIELDS]
    return d.select(F.coalesce("symbol", F.get("tickers", 0)).alias("symbol"), "cik", *arrays)


def read_filings(spark: SparkSession, path: str, layout: str | None = None) -> DataFrame:
    return parse_filings(filing_payloads(spark, path, layout))


def filing_archive(recent: DataFrame, shards: DataFrame, start) -> DataFrame:
    """Recent filings plus archive shards whose `filing_to` is not before `start`; with shards partitioned by that
    column the others are never read."""
    kept = shards.where(F.col("filing_to") >= F.lit(start)).drop("filing_to")
    return parse_filings(recent).unionByName(parse_filings(kept))


def with_company(shards: DataFrame, recent: DataFrame) -> DataFrame:
    """Archive shards with the keys they lack: the cik from the file's name (`CIK0000004711-…`), the symbol from the recent
    document of that cik. Shards of a company without a recent document keep a null symbol."""
    number = F.nullif(F.ltrim(F.coalesce("cik", F.nullif(F.regexp_extract("path", r"CIK(\d+)[^/]*$", 1), F.lit(""))), F.lit("0")), F.lit(""))
    known = recent.select(F.ltrim("cik", F.lit("0")).alias("_number"), F.col("symbol").alias("_symbol"), F.col("cik").alias("_cik"))
    known = known.where("_number IS NOT NULL").groupBy("_number").agg(F.min(F.struct("_symbol", "_cik")).alias("known"))
    rows = shards.withColumn("_number", number).join(known, "_number", "left")
    return rows.withColumns({
        "symbol": F.coalesce("symbol", "known._symbol"), "cik": F.coalesce("cik", "known._cik", "_number"),
    }).drop("_number", "known", "path")


def read_filing_archive(spark: SparkSession, recent_path: str, archive_path: str, start) -> DataFrame:
    """The archive lies in folders `filing_to=…`, one document per line."""
    shards = spark.read.schema(T.StructType([*FILING_PAYLOAD.fields, T.StructField("filing_to", T.StringType())])).json(archive_path)
    recent = filing_payloads(spark, recent_path)
    return filing_archive(recent, with_company(shards.select("*", F.col("_metadata.file_path").alias("path")), recent), start)


def parse_catalog(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Directory text, a list or a map of entries, to rows; entries without ticker or title are dropped."""
    text = F.trim(column)
    listed = F.from_json(F.when(text.startswith("["), text), T.ArrayType(schemas.CATALOG_ITEM))
    mapped = F.map_values(F.from_json(F.when(text.startswith("{"), text), T.MapType(T.StringType(), schemas.CATALOG_ITEM)))
    rows = payloads.select(F.inline(F.coalesce(listed, mapped))).where(
        (F.coalesce("ticker", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))
    return rows.select(
        F.upper("ticker").alias("symbol"), F.initcap("title").alias("name"),
        F.lpad(F.coalesce("cik_str", F.lit("")), 10, "0").alias("cik"), F.lit("US").alias("exchange"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return parse_catalog(spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload"))


SUPPLEMENT_FILE = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("quarters", T.ArrayType(schemas.SUPPLEMENT_ITEM))])


def parse_supplements(files: DataFrame) -> DataFrame:
    """Quarterly EPS supplements, one per symbol and period end; the last listed wins."""
    rows = files.select("symbol", F.posexplode("quarters").alias("pos", "q")).select(
        "symbol", S.safe_date(F.col("q.start")).alias("start"), S.safe_date(F.col("q.end")).alias("end"),
        S.safe_date(F.col("q.filed")).alias("filed"), F.col("q.form").alias("form"), F.col("q.accn").alias("accn"),
        S.parse_number(F.col("q.val")).alias("val"), F.col("pos").cast("long").alias("pos"))
    return keep_latest(rows.where("end IS NOT NULL"), ["symbol", "end"], "pos")


def read_supplements(spark: SparkSession, path: str) -> DataFrame:
    return parse_supplements(spark.read.schema(SUPPLEMENT_FILE).json(path))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report pages: a parquet corpus (page_id, url, html), or a folder of page files, one page per file.
    Bytes that are not UTF-8 become U+FFFD."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    return files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
