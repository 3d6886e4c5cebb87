"""Readers of nested documents, and their tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import brackets

TRANSACTION = "struct<description: string, ticker: string, type: string, date: string, amount: string, lateFilingFlag: boolean, notes: string>"
FILING = "struct<date: string, url: string, label: string>"
OFFICIAL = (
    "name string, slug string, title string, agency string, level string, party string, filingType string, dataStatus string, formerOfficial boolean, "
    "mostRecentFilingDate string, lastIngestedDate string, lastIngestedNewCount int, confirmedDate string, tookOfficeDate string, ethicsAgreementDate string, "
    f"departedDate string, summary string, transactions array<{TRANSACTION}>, sourceFilings array<{FILING}>"
)
NEWS = "official string, headline string, source string, date string, url string, relevance string"
FEES_FILE = "payments array<struct<officialSlug: string, officialName: string, pdfFile: string, filingLabel: string, pdfUrl: string, annotationRaw: string, annotationCleaned: string, reviewerDate: string, outcome: string>>"
FEES = "officialSlug string, officialName string, pdfFile string, filingLabel string, pdfUrl string, annotationRaw string, annotationCleaned string, reviewerDate string, outcome string"
SOURCE_DOCS = "official string, displayName string, generatedAt string, documents array<struct<kind: string, label: string, title: string, filedDate: string, publiclyDownloadable: boolean, pdfPath: string, ogeUrl: string, summary: string>>"
HOLDINGS = "section string, itemNumber string, parentItemNumber string, description string, ticker string, isEIF boolean, eif string, value string, incomeType string, incomeAmt struct<bucket: string, exact: string>"
DIVESTITURE = "confirmedDate string, promises array<struct<entity: string, ticker: string, section: string, action: string, deadline: string, matchedSaleTickers: array<string>, matchedSaleDescriptionTokens: array<string>>>"
PARSED = "transactions array<struct<description: string, ticker: string, type: string, date: string, amount: string, lateFilingFlag: boolean, notes: string, confidence: double>>, tokenUsage struct<inputTokens: long, outputTokens: long, estimatedCostUsd: double>, model string, pdfPath string"
LOG_ENTRY = "date string, lede string, trackedOfficialCount int, items array<struct<slug: string, name: string, newCount: int>>"
LAST_CHECK = "lastChecked string, knownFilings map<string, int>, knownFilingsByOfficial map<string, int>, knownFilingUrls array<string>, newFilings array<struct<name: string, pdfUrl: string, docDate: string, status: string>>"


def read_json(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """Documents of one file or a folder of files, with the file each came from; a malformed one is left out.

    optional: a missing path is an empty table.
    """
    full = f"{schema}, __corrupt string"
    try:
        read = spark.read.schema(full).option("multiLine", True).option("columnNameOfCorruptRecord", "__corrupt").json(path)
    except AnalysisException as error:
        if not optional or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, file string")
    # The second condition always holds; a query of the corrupt record's column alone is refused.
    parsed = F.coalesce(F.length(F.to_json(F.struct(F.col(read.columns[0])))), F.lit(0)) >= 0
    return read.withColumn("file", F.col("_metadata.file_name")).filter(F.col("__corrupt").isNull() & parsed).drop("__corrupt")


def officials(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, OFFICIAL)


def roster(documents: DataFrame) -> DataFrame:
    """Officials whose data is parsed and who are in office."""
    return documents.filter((F.col("dataStatus") == "parsed") & ~F.coalesce("formerOfficial", F.lit(False)))


def official(documents: DataFrame, slug: str) -> DataFrame:
    """One official's document, empty if there is none; a name written first to last is tried the other way round, too."""
    swapped = "-".join(reversed(slug.split("-", 1)))
    return documents.filter(F.col("slug").isin(slug, swapped)).orderBy((F.col("slug") != slug).cast("int")).limit(1)


def transactions(documents: DataFrame) -> DataFrame:
    """The rows inside of documents, with their places."""
    rows = documents.select("slug", "name", "agency", F.posexplode("transactions").alias("row_index", "t"))
    return rows.select("slug", "name", "agency", "row_index", "t.*")


def source_filings(documents: DataFrame) -> DataFrame:
    rows = documents.select("slug", F.posexplode("sourceFilings").alias("ordinal", "f"))
    return rows.select("slug", "ordinal", "f.*")


def log_entries(spark: SparkSession, path: str) -> DataFrame:
    """Published log entries that have items, named by date."""
    rows = read_json(spark, path, LOG_ENTRY, optional=True)
    return rows.filter((F.size("items") > 0) & F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"))


def log_entry(entries: DataFrame, date: str) -> DataFrame:
    """The entry of one date; a key that isn't a date finds nothing."""
    return entries.filter((F.col("date") == date) & F.lit(date).rlike(r"^\d{4}-\d{2}-\d{2}$"))


def updates(spark: SparkSession, path: str) -> DataFrame:
    """Published log entries with their counts, newest first."""
    rows = log_entries(spark, path)
    trades = F.aggregate("items", F.lit(0).cast("long"), lambda n, i: n + F.coalesce(i["newCount"], F.lit(0)))
    return rows.select(
        "date", "lede", "items", F.coalesce("trackedOfficialCount", F.lit(0)).alias("trackedOfficialCount"), F.size("items").alias("officialCount"), trades.alias("tradeCount")
    ).orderBy(F.desc("date"))


def news(spark: SparkSession, path: str, slug: str | None = None) -> DataFrame:
    """News, newest first; with a slug that official's alone. Equal dates are in the order of links."""
    rows = read_json(spark, path, NEWS)
    return _of(rows, "official", slug).orderBy(F.desc_nulls_last(F.coalesce(F.try_to_timestamp("date"), F.try_to_date("date"))), "url")


def fee_payments(spark: SparkSession, path: str, slug: str | None = None) -> DataFrame:
    """Recorded fee payments; none before the file is there."""
    rows = read_json(spark, path, FEES_FILE, optional=True).select(F.explode("payments").alias("p")).select("p.*")
    return _of(rows, "officialSlug", slug)


def source_documents(spark: SparkSession, path: str, slug: str | None = None) -> DataFrame:
    """The documents that each official's file lists; a file is named by its official."""
    rows = _named(read_json(spark, path, SOURCE_DOCS, optional=True), slug)
    return rows.select("slug", "displayName", "generatedAt", F.posexplode("documents").alias("ordinal", "d")).select("slug", "displayName", "generatedAt", "ordinal", "d.*")


def holdings(spark: SparkSession, path: str, slug: str | None = None) -> DataFrame:
    """The rows of holdings of each official's file."""
    return _named(read_json(spark, path, HOLDINGS, optional=True), slug)


def divestitures(spark: SparkSession, path: str, slug: str | None = None) -> DataFrame:
    """The promises of each official's file, with the date that sales count from."""
    rows = _named(read_json(spark, path, DIVESTITURE, optional=True), slug)
    return rows.select("slug", "confirmedDate", F.posexplode("promises").alias("ordinal", "p")).select("slug", "confirmedDate", "ordinal", "p.*")


def parsed_filings(spark: SparkSession, path: str) -> DataFrame:
    """The transactions of parsed files, with the file and its model; malformed files are left out."""
    rows = read_json(spark, path, PARSED, optional=True)
    return rows.select("file", "model", F.posexplode("transactions").alias("row_index", "t")).select("file", "model", "row_index", "t.*")


def _of(rows: DataFrame, column: str, slug: str | None) -> DataFrame:
    return rows if slug is None else rows.filter(F.col(column) == slug)


def _named(rows: DataFrame, slug: str | None) -> DataFrame:
    """Adds slug, the name of the file a row came from; with a slug that file's rows alone."""
    return _of(rows.withColumn("slug", F.regexp_replace("file", r"\.json$", "")), "slug", slug)


def dataset(documents: DataFrame) -> DataFrame:
    """The nested export's documents: an official's own fields, its number of transactions and they themselves."""
    own = ("name", "slug", "title", "agency", "level", "confirmedDate", "departedDate")
    rows = F.coalesce("transactions", F.array().cast(f"array<{TRANSACTION}>"))
    return documents.select(*own, F.size(rows).alias("transactionCount"), "mostRecentFilingDate", rows.alias("transactions"))


def summary(documents: DataFrame) -> DataFrame:
    """One row for each official with what its transactions add up to, for the thirteen-column file."""
    rows = F.coalesce("transactions", F.array().cast(f"array<{TRANSACTION}>"))
    some = lambda test: F.size(F.filter(rows, test))
    value = F.aggregate(rows, F.lit(0).cast("long"), lambda n, t: n + F.coalesce(brackets.midpoint(t["amount"], "export"), F.lit(0)).cast("long"))
    return documents.select(
        "name", "slug", "title", "agency", "level", F.col("confirmedDate").alias("confirmed_date"), F.col("departedDate").alias("departed_date"),
        F.size(rows).alias("transaction_count"), some(lambda t: brackets.is_sale(t["type"])).alias("sales_count"), some(lambda t: t["type"] == "Purchase").alias("purchases_count"),
        some(lambda t: F.coalesce(t["lateFilingFlag"], F.lit(False))).alias("late_filing_count"), value.alias("estimated_total_value"), F.col("mostRecentFilingDate").alias("most_recent_oge_filing_date"),
    )


def known_urls(documents: DataFrame, last_check: DataFrame) -> DataFrame:
    """Every link known from documents, or from the state of the last check in any of its three forms."""
    own = documents.select(F.explode("sourceFilings.url").alias("url"))
    listed = last_check.select(F.explode("knownFilingUrls").alias("url"))
    keys = last_check.select(F.explode(F.map_keys("knownFilings")).alias("url")).filter(F.col("url").startswith("http"))
    new = last_check.select(F.explode("newFilings.pdfUrl").alias("url"))
    return own.union(listed).union(keys).union(new).filter("url IS NOT NULL AND url <> ''").distinct()
