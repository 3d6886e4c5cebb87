"""Rules on data quality: independent errors, anomalies and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import brackets
from folioflow.operators.rollups import n_if, total

FIRST_DATE = "2019-01-01"
SHAPE = r"^\d{4}-\d{2}-\d{2}$"
#: Tickers known to be right.
KNOWN_TICKERS = [
    "AAPL",
    "AMZN",
    "MSFT",
    "GOOGL",
    "GOOG",
    "META",
    "TSLA",
    "NVDA",
    "JPM",
    "BAC",
    "WFC",
    "GS",
    "MS",
    "C",
    "USB",
    "PNC",
    "TFC",
    "UNH",
    "JNJ",
    "PFE",
    "MRK",
    "ABBV",
    "LLY",
    "BMY",
    "AMGN",
    "XOM",
    "CVX",
    "COP",
    "SLB",
    "EOG",
    "MPC",
    "VLO",
    "PSX",
    "DIS",
    "NFLX",
    "CMCSA",
    "T",
    "VZ",
    "TMUS",
    "HD",
    "LOW",
    "TGT",
    "WMT",
    "COST",
    "V",
    "MA",
    "PYPL",
    "SQ",
    "AXP",
    "SPY",
    "QQQ",
    "IWM",
    "DIA",
    "VOO",
    "VTI",
    "BND",
    "BA",
    "LMT",
    "RTX",
    "GD",
    "NOC",
    "DJT",
    "LBRT",
    "OKLO",
    "FISV",
]


def _rules(today: str, date: Column) -> tuple[tuple[Column, Column], ...]:
    """Each rule that may be broken, and its text; date: date_text parsed, null if it has another shape or is no date."""
    text = F.coalesce("date_text", F.lit(""))
    shaped = text.rlike(SHAPE)
    none = lambda c: F.coalesce(~c, F.lit(True))
    quoted = lambda start, c: F.concat(F.lit(f'{start}: "'), F.coalesce(F.col(c), F.lit("")), F.lit('"'))
    return (
        (F.trim(F.coalesce("description", F.lit(""))) == "", F.lit("Empty description")),
        (none(F.col("type").isin(*brackets.TYPES)), quoted("Invalid type", "type")),
        (none(F.col("amount").isin(*(b[0] for b in brackets.BRACKETS))), quoted("Invalid amount", "amount")),
        (~shaped, quoted("Invalid date format", "date_text")),
        (shaped & date.isNull(), quoted("Unparseable date", "date_text")),
        (date > F.lit(today).cast("date"), quoted("Future date", "date_text")),
        (date < F.lit(FIRST_DATE).cast("date"), quoted("Date before 2019", "date_text")),
        (F.col("late").isNull(), F.lit("late flag missing")),
        ((F.col("ticker") != "") & ~F.col("ticker").rlike(r"^[A-Za-z.]{1,10}$"), quoted("Suspicious ticker", "ticker")),
    )


def _parsed() -> Column:
    text = F.coalesce("date_text", F.lit(""))
    return F.try_to_date(F.when(text.rlike(SHAPE), text), "yyyy-MM-dd")


def errors(today: str) -> Column:
    """The broken rules of a row as an array of texts; date_text is a date as it was written."""
    return F.array_compact(F.array(*(F.when(test, text_) for test, text_ in _rules(today, _parsed()))))


def has_errors(today: str) -> Column:
    """Whether any rule is broken: the tests alone, without their texts."""
    return reduce(lambda a, b: a | b, (F.coalesce(test, F.lit(False)) for test, _ in _rules(today, _parsed())))


def error_rows(rows: DataFrame, today: str, group: str, index: str) -> DataFrame:
    """One row for each error, with the prefix that tells its place."""
    prefix = F.concat(F.lit("["), F.col(group).cast("string"), F.lit("]["), F.col(index).cast("string"), F.lit("] "))
    dated = rows.withColumn("__date", _parsed())
    broken = F.array(*(F.when(test, text) for test, text in _rules(today, F.col("__date"))))
    # Each rule's text is an element, and those that hold are left out after the explode: no array is made twice.
    return dated.select(group, index, F.explode(broken).alias("e")).filter("e IS NOT NULL").select(group, index, F.concat(prefix, "e").alias("error"))


def counters(rows: DataFrame, today: str, least_confidence: float = 0.8) -> DataFrame:
    """One row: rows, those with errors, unknown tickers, those of low confidence, and the verdict."""
    known = F.coalesce(F.col("ticker").isin(*KNOWN_TICKERS), F.lit(True)) | (F.col("ticker") == "")
    out = rows.withColumn("bad", has_errors(today)).agg(
        F.count("*").alias("n"), n_if(F.col("bad")).alias("failures"), F.countDistinct(F.when(~known, F.col("ticker"))).alias("unknown_tickers"), n_if(F.col("confidence") < least_confidence).alias("low_confidence")
    )
    return out.withColumn("verdict", F.when(F.col("failures") > 0, "FAIL").otherwise("PASS"))


def verdict(counted: DataFrame, golden: DataFrame) -> DataFrame:
    """The counters' one row with the golden groups beside it: PASS without failures and with all groups passed.

    golden: passed, a row for each group; no group at all fails nothing.
    """
    sums = golden.agg(n_if(F.col("passed")).alias("golden_passed"), F.count("*").alias("golden_total"))
    failed = (F.col("failures") > 0) | (F.col("golden_passed") < F.col("golden_total"))
    return counted.crossJoin(sums).withColumn("verdict", F.when(failed, "FAIL").otherwise("PASS"))


def pinned(counts: dict[str, DataFrame], pins: dict[str, int]) -> DataFrame:
    """Counts beside the values they are pinned to. counts: a DataFrame of one row, n, for each name."""
    rows = [df.select(F.lit(name).alias("name"), "n", F.lit(pins[name]).cast("long").alias("pinned")) for name, df in counts.items()]
    return reduce(DataFrame.union, rows).withColumn("holds", F.col("n") == F.col("pinned"))


def assert_pinned(checked: DataFrame) -> DataFrame:
    """The same rows; one that doesn't hold ends the job with an error."""
    said = F.concat(F.lit("count of "), "name", F.lit(" is "), F.col("n").cast("string"), F.lit(", pinned to "), F.col("pinned").cast("string"))
    return checked.withColumn("holds", F.when(F.col("holds"), True).otherwise(F.raise_error(said).cast("boolean")))


def unknown_tickers(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("ticker") != "") & ~F.col("ticker").isin(*KNOWN_TICKERS)).groupBy("ticker").agg(F.count("*").alias("n"))


def anomalies(rows: DataFrame, group: str, key: list[str], many: int = 200, single_day: int = 10) -> DataFrame:
    """Groups that are very large, have repeated rows, or have all of many rows on one day."""
    by_key = rows.groupBy(group, "date", *key).agg(F.count("*").alias("n"))
    by_day = by_key.groupBy(group, "date").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("again"))
    per = by_day.groupBy(group).agg(total(F.col("n")).alias("n"), total(F.col("again")).alias("duplicates"), F.count("*").alias("days"))
    out = per.withColumns({"large": F.col("n") > many, "one_day": (F.col("days") == 1) & (F.col("n") > single_day)})
    return out.filter("large OR one_day OR duplicates > 0").select(group, "n", "duplicates", "large", "one_day")


def checks(tx: DataFrame, officials: DataFrame) -> DataFrame:
    """Counts of rows that break a table's rules, in both tables, and the verdict."""
    blank = lambda c: n_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"no_{c}")
    facts = tx.agg(F.count("*").alias("n"), blank("description"), blank("type"), blank("date"), blank("ticker"))
    orphans = tx.join(officials.select("official_id"), "official_id", "left_anti").agg(F.count("*").alias("orphans"))
    idle = officials.join(tx.select("official_id").distinct(), "official_id", "left_anti").agg(F.count("*").alias("idle"))
    out = facts.crossJoin(orphans).crossJoin(idle)
    issues = F.col("no_description") + F.col("no_type") + F.col("no_date") + F.col("orphans")
    return out.withColumns({"issues": issues, "verdict": F.when(issues > 0, "FAIL").otherwise("PASS")})
