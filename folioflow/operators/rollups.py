"""Aggregates over transactions.

A transactions table has the columns official_id, official, level, agency, description, ticker, type,
date, amount, late, and ordinal columns that order its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import brackets, classify, scalars

ORDER = ("date", "filing", "line", "part", "supplier")


def total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def n_if(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def _sale() -> Column:
    return brackets.is_sale(F.col("type"))


def _mid(variant: str = "site") -> Column:
    return brackets.midpoint(F.col("amount"), variant)


def headline(tx: DataFrame, roster: DataFrame) -> DataFrame:
    """One row for all: officials, transactions, estimated value, late ones and their share."""
    facts = tx.agg(F.count("*").alias("transactions"), total(_mid()).alias("estimated_value"), n_if(F.col("late")).alias("late"))
    return facts.crossJoin(roster.agg(F.count("*").alias("officials"))).withColumn("late_percent", scalars.percent(F.col("late"), F.col("transactions")))


def latest(tx: DataFrame) -> DataFrame:
    return tx.agg(F.coalesce(F.max("date").cast("string"), F.lit("")).alias("latest"))


def official_summary(roster: DataFrame, tx: DataFrame, variant: str = "export") -> DataFrame:
    """Counts and the estimate for each official; one without transactions keeps a row of zeros."""
    per = tx.groupBy("official_id").agg(
        F.count("*").alias("n"), n_if(_sale()).alias("n_sales"), n_if(F.col("type") == "Purchase").alias("n_buys"), n_if(F.col("late")).alias("n_late"), total(_mid(variant)).alias("value")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return roster.join(per, "official_id", "left").select("official_id", "official", *map(zero, ("n", "n_sales", "n_buys", "n_late", "value")))


def by_ticker(tx: DataFrame) -> DataFrame:
    """Trades, buys, sells, distinct officials and the estimate for each upper-cased ticker."""
    return with_ticker(tx).groupBy("ticker").agg(
        F.count("*").alias("trades"), n_if(F.col("type") == "Purchase").alias("buys"), n_if(_sale()).alias("sells"), F.countDistinct("official_id").alias("officials"), total(_mid()).alias("value")
    )


def with_ticker(tx: DataFrame) -> DataFrame:
    return tx.filter(F.col("ticker").isNotNull() & (F.col("ticker") != "")).withColumn("ticker", F.upper("ticker"))


def ticker_names(tx: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """The cleaned description of each ticker's first row; overrides replace names that they list."""
    first = with_ticker(tx).groupBy("ticker").agg(F.min_by("description", F.struct(*ORDER)).alias("description"))
    pairs = [F.lit(x) for pair in (overrides or {"": ""}).items() for x in pair]
    return first.select("ticker", F.coalesce(F.create_map(*pairs)[F.col("ticker")], scalars.company_name(F.col("description"))).alias("company"))


def ticker_officials(tx: DataFrame) -> DataFrame:
    """Each official's trades in a ticker, with their place by value and the ticker's largest value."""
    per = with_ticker(tx).groupBy("ticker", "official_id").agg(F.count("*").alias("trades"), total(_mid()).alias("value"))
    w = Window.partitionBy("ticker")
    return per.withColumns({"place": F.row_number().over(w.orderBy(F.desc("value"), "official_id")).cast("long"), "largest": F.max("value").over(w)})


def split(tx: DataFrame) -> DataFrame:
    """Buys against sales by count and value; exchanges are in neither."""
    buy = F.col("type") == "Purchase"
    sides = tx.agg(n_if(_sale()).alias("sales"), n_if(buy).alias("buys"), total(F.when(_sale(), _mid())).alias("sales_value"), total(F.when(buy, _mid())).alias("buys_value"))
    return sides.withColumn("sales_percent", scalars.percent(F.col("sales_value"), F.col("sales_value") + F.col("buys_value")))


def by_asset_class(tx: DataFrame) -> DataFrame:
    """Sums by class. Rows are added up by description first, so that each different one is classified once."""
    known = F.coalesce(F.col("ticker") != "", F.lit(False)).alias("known")
    per = tx.groupBy("description", known).agg(total(_mid()).alias("value"), F.count("*").alias("trades"))
    kind = classify.asset_class(F.col("description"), F.col("known"))
    return per.groupBy(kind.alias("asset_class")).agg(total(F.col("value")).alias("value"), total(F.col("trades")).alias("trades"))


def late_stats(tx: DataFrame) -> DataFrame:
    """Self-certified lateness of each official that has any."""
    late = F.col("late")
    per = tx.groupBy("official_id", "official").agg(
        F.count("*").alias("n"),
        n_if(late).alias("n_late"),
        n_if(late & _sale()).alias("late_sales"),
        n_if(late & (F.col("type") == "Purchase")).alias("late_buys"),
        F.min(F.when(late, F.col("date"))).alias("first_late"),
        F.max(F.when(late, F.col("date"))).alias("last_late"),
    )
    return per.filter("n_late > 0").withColumn("rate", F.col("n_late") * 100 / F.col("n"))


def late_overall(tx: DataFrame) -> DataFrame:
    per = tx.groupBy("official_id").agg(F.count("*").alias("n"), n_if(F.col("late")).alias("n_late"))
    return per.agg(
        total(F.col("n")).alias("n"),
        total(F.col("n_late")).alias("n_late"),
        n_if(F.col("n_late") > 0).alias("late_officials"),
        F.coalesce(F.floor(F.sum("n_late") * 1000 / F.sum("n") + 0.5), F.lit(0)).cast("long").alias("rate_per_mille"),
    )


def cohorts(stats: DataFrame) -> DataFrame:
    """Officials that are always late, and those that mostly are."""
    cohort = F.when(F.col("n_late") == F.col("n"), "always").when(F.col("n_late") * 2 > F.col("n"), "mostly")
    return stats.withColumn("cohort", cohort).filter("cohort IS NOT NULL").groupBy("cohort").agg(F.count("*").alias("officials"), total(F.col("n_late")).alias("n_late"))


def fee_exposure(tx: DataFrame, fee: int = 200) -> DataFrame:
    """Reports with any late row, at a fee each, beside the number of late rows."""
    per = tx.groupBy("official_id", "filing").agg(n_if(F.col("late")).alias("n_late"))
    return per.groupBy("official_id").agg(n_if(F.col("n_late") > 0).alias("late_reports"), total(F.col("n_late")).alias("n_late")).withColumn("exposure", F.col("late_reports") * fee)


def remainder(tx: DataFrame, official_id: int) -> DataFrame:
    """The late total without one official's part."""
    own = F.col("official_id") == official_id
    return tx.agg(n_if(F.col("late")).alias("late"), n_if(F.col("late") & own).alias("own"), n_if(F.col("late") & ~own).alias("others"))


def ranking(tx: DataFrame, k: int = 15) -> DataFrame:
    """The k officials with the highest estimates."""
    per = tx.groupBy("official_id", "official").agg(total(_mid()).alias("value"), F.count("*").alias("trades"))
    best = per.orderBy(F.desc("value"), "official_id").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "official_id")).cast("long"))


def nested_trades(tx: DataFrame) -> DataFrame:
    """Each official with its transactions as arrays, newest first: a row for each year, so that no array has all of an official's rows."""
    rows = F.sort_array(F.collect_list(F.struct("date", "filing", "line", "part", "supplier", "description", "type", "amount")), asc=False)
    return tx.groupBy("official_id", F.year("date").alias("year")).agg(rows.alias("trades"), total(_mid()).alias("value"))


def top_assets(tx: DataFrame, k: int = 5) -> DataFrame:
    """Each official's k assets, by ticker or else description, with the most rows."""
    per = tx.groupBy("official_id", F.coalesce(F.nullif("ticker", F.lit("")), F.col("description")).alias("asset")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("official_id").orderBy(F.desc("n"), "asset")).cast("long")
    return per.withColumn("place", place).filter(F.col("place") <= k)


def summary_stats(tx: DataFrame) -> DataFrame:
    """Counts and sums by type, the range of dates and the largest row, the first one in order among equals."""
    mid = _mid("export")
    of = lambda c: total(F.when(c, mid))
    largest = F.max_by(F.concat("description", F.lit(" ("), "amount", F.lit(")")), F.struct(mid, *(-F.col(c) if c != "date" else -F.datediff("date", F.lit("1970-01-01").cast("date")) for c in ORDER)))
    return tx.groupBy("official_id", "official").agg(
        F.count("*").alias("n"),
        n_if(_sale()).alias("n_sales"),
        n_if(F.col("type") == "Purchase").alias("n_buys"),
        n_if(F.col("type") == "Exchange").alias("n_exchanges"),
        n_if(F.col("late")).alias("n_late"),
        total(mid).alias("value"),
        of(_sale()).alias("sales_value"),
        of(F.col("type") == "Purchase").alias("buys_value"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        largest.alias("largest"),
    )


def sentences(stats: DataFrame) -> DataFrame:
    """A sentence about each official from its counts."""
    part = lambda n, noun: F.when(F.col(n) > 0, scalars.counted(F.col(n), noun))
    what = F.nullif(F.concat_ws(" and ", part("n_sales", "sale"), part("n_buys", "purchase"), part("n_exchanges", "exchange")), F.lit(""))
    late = F.when(F.col("n_late") > 0, F.concat(F.lit(" "), scalars.counted(F.col("n_late"), "transaction"), F.lit(" were filed late."))).otherwise("")
    text = F.concat(F.get(F.split("official", ","), F.lit(0)), F.lit(" reported "), F.coalesce(what, F.lit("no transactions")), F.lit("."), late)
    return stats.select("official_id", text.alias("sentence"))


def follow_breakdown(recipients: DataFrame, slugs: DataFrame) -> DataFrame:
    """How many recipients follow all, how many a digest reaches and how many it leaves out."""
    marked = recipients.join(slugs.select("slug").distinct().withColumn("hit", F.lit(True)), "slug", "left")
    everyone, hit = F.col("slug").isNull(), F.coalesce("hit", F.lit(False))
    return marked.agg(F.count("*").alias("total"), n_if(everyone).alias("all_followers"), n_if(everyone | hit).alias("reached"), n_if(~everyone & ~hit).alias("excluded"))
