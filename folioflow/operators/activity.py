"""Activity over time: dense months, days, rhythm and cadence of filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import brackets
from folioflow.operators.rollups import n_if, total


def month_axis(dated: DataFrame, start: str) -> DataFrame:
    """Every month from start to the last of the data, start alone if that is earlier."""
    end = F.greatest(F.lit(start).cast("date"), F.coalesce(F.max(F.trunc("date", "month")), F.lit(start).cast("date")))
    return dated.agg(end.alias("end")).select(F.explode(F.sequence(F.lit(start).cast("date"), "end", F.expr("INTERVAL 1 MONTH"))).alias("month"))


def by_month(tx: DataFrame, start: str) -> DataFrame:
    """Sales, and all else as purchases, in every month of the axis; rows outside of it are left out."""
    sale = brackets.is_sale(F.col("type"))
    per = tx.groupBy(F.trunc("date", "month").alias("month")).agg(n_if(sale).alias("sales"), n_if(~sale).alias("purchases"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return month_axis(tx, start).join(per, "month", "left").select("month", zero("sales"), zero("purchases"))


def series_by_month(tx: DataFrame, key: str) -> DataFrame:
    """Each key's months, from its first to its last: sales, purchases, late ones and all; exchanges only in all."""
    month = F.trunc("date", "month")
    span = tx.groupBy(key).agg(F.min(month).alias("low"), F.max(month).alias("high"))
    axis = span.select(key, F.explode(F.sequence("low", "high", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    per = tx.groupBy(key, month.alias("month")).agg(
        n_if(brackets.is_sale(F.col("type"))).alias("sales"), n_if(F.col("type") == "Purchase").alias("purchases"), n_if(F.col("late")).alias("late"), F.count("*").alias("total")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return axis.join(per, [key, "month"], "left").select(key, "month", *map(zero, ("sales", "purchases", "late", "total")))


def peak(months: DataFrame) -> DataFrame:
    return months.agg(F.coalesce(F.max(F.greatest("sales", "purchases")), F.lit(0)).cast("long").alias("peak"))


def span_label(months: DataFrame) -> DataFrame:
    """Active months of all, the first and the last active one."""
    active = (F.col("sales") + F.col("purchases")) > 0
    return months.agg(n_if(active).alias("active"), F.count("*").alias("months"), F.min(F.when(active, F.col("month"))).alias("first_active"), F.max(F.when(active, F.col("month"))).alias("last_active"))


def top_months(months: DataFrame, k: int = 3) -> DataFrame:
    """The k months with the most rows; those without any go after the choice."""
    best = months.withColumn("total", F.col("sales") + F.col("purchases")).orderBy(F.desc("total"), "month").limit(k)
    return best.filter("total > 0").select("month", "total")


def daily(tx: DataFrame, key: str, many: int = 100) -> DataFrame:
    """The busiest day, the earliest among equals, and the number of days with many rows."""
    per = tx.groupBy(key, "date").agg(F.count("*").alias("n"))
    return per.groupBy(key).agg(
        F.max("n").alias("peak"), F.min_by("date", F.struct(-F.col("n"), F.col("date"))).alias("peak_day"), F.count("*").alias("days"), n_if(F.col("n") >= many).alias("busy_days")
    )


def rhythm(tx: DataFrame, key: str, large: int = 500, busy_month: int = 50) -> DataFrame:
    """Rows a week over the span of a key's dates, its busiest month, and whether it counts as high volume."""
    month = tx.groupBy(key, F.trunc("date", "month").alias("month")).agg(F.count("*").alias("n"), F.min("date").alias("low"), F.max("date").alias("high"))
    per = month.groupBy(key).agg(total(F.col("n")).alias("n"), F.max("n").alias("busiest"), F.datediff(F.max("high"), F.min("low")).alias("days"))
    weeks = F.greatest(F.lit(1.0), F.col("days") / 7.0)
    return per.select(key, "n", "busiest", (F.col("n") / weeks).alias("per_week"), ((F.col("n") >= large) | (F.col("busiest") >= busy_month)).alias("high_volume"))


def density(tx: DataFrame, key: str) -> DataFrame:
    """Most rows on one day, distinct days, and whether all rows are of one side."""
    per = tx.groupBy(key, "date").agg(F.count("*").alias("n"), n_if(brackets.is_sale(F.col("type"))).alias("sales"), n_if(F.col("type") == "Purchase").alias("buys"))
    out = per.groupBy(key).agg(F.max("n").alias("most"), F.count("*").alias("days"), total(F.col("n")).alias("n"), total(F.col("sales")).alias("sales"), total(F.col("buys")).alias("buys"))
    note = F.when(F.col("sales") == F.col("n"), "all sales").when(F.col("buys") == F.col("n"), "all purchases").otherwise("mixed")
    return out.select(key, "most", "days", note.alias("note"))


def gaps(filings: DataFrame, key: str) -> DataFrame:
    """Days since the key's previous distinct date; null for the first."""
    w = Window.partitionBy(key).orderBy("date")
    return filings.select(key, "date").distinct().withColumn("gap", F.datediff("date", F.lag("date").over(w)).cast("long"))


def cadence(filings: DataFrame, key: str, today: str, floor: str, least: int = 4) -> DataFrame:
    """The upper median of the gaps between filings, and the next date that it projects.

    Gaps are counted by size, and the median is the first size whose running count passes half of them: a key has as
    many rows as different gaps, and no array of them.
    """
    counted = gaps(filings.filter(F.col("date") >= F.lit(floor).cast("date")), key).groupBy(key, "gap").agg(F.count("*").alias("n"), F.max("date").alias("last"))
    by_gap = Window.partitionBy(key).orderBy("gap")
    # The first date has a null gap, which sorts before the others.
    running = counted.withColumns({"upto": F.sum("n").over(by_gap) - 1, "filings": F.sum("n").over(Window.partitionBy(key))})
    passed = F.when(F.col("gap").isNotNull() & (F.col("upto") > F.floor((F.col("filings") - 1) / 2)), F.col("gap"))
    per = running.groupBy(key).agg(F.max("filings").alias("filings"), F.max("last").alias("last_filing"), F.min(passed).alias("median_gap")).filter(F.col("filings") >= least)
    projected = F.date_add("last_filing", F.col("median_gap").cast("int"))
    return per.select(key, "filings", "last_filing", "median_gap", projected.alias("projected"), F.datediff(F.lit(today).cast("date"), projected).cast("long").alias("days_past"))


def padded_domain(tx: DataFrame, key: str) -> DataFrame:
    """The range of a key's dates with four percent of it added on either side, thirty days if it is one day."""
    per = tx.groupBy(key).agg(F.min("date").alias("low"), F.max("date").alias("high"))
    pad = F.when(F.col("low") == F.col("high"), 30).otherwise(F.ceil(F.datediff("high", "low") * 0.04)).cast("int")
    return per.select(key, F.date_sub("low", pad).alias("low"), F.date_add("high", pad).alias("high"))


def month_stride(spans: DataFrame, ticks: int = 6) -> DataFrame:
    """Every how many months a tick stands so that there are about so many."""
    months = F.floor(F.months_between(F.trunc("high", "month"), F.trunc("low", "month"))) + 1
    return spans.withColumn("stride", F.greatest(F.lit(1), F.ceil(months / ticks)).cast("long"))


def jitter(tx: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Place of a row among those of its day, and how many these are."""
    day = Window.partitionBy(key, "date")
    return tx.withColumns({"day_place": (F.row_number().over(day.orderBy(*order)) - 1).cast("long"), "day_rows": F.count("*").over(day)})
