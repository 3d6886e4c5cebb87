"""Rankings, pages and scales; every order ends with a key, so that ties have one result."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def top(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with their places; only k rows reach the window."""
    return rows.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def numbered(rows: DataFrame, coarse: dict[str, bool], fine: list[Column], name: str) -> DataFrame:
    """Adds name: each row's place by the columns of coarse, which rise where True and fall where False, then by fine.

    Rows are numbered inside the groups of equal coarse values, and the groups' counts are added up over one row for each
    group, so that no task has all the rows.
    """
    order = [F.asc(c) if rises else F.desc(c) for c, rises in coarse.items()]
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    counts = rows.groupBy(*coarse).agg(F.count("*").alias("__n"))
    groups = counts.select(*coarse, before).toDF(*(f"__g_{c}" for c in coarse), "__before")
    nth = F.row_number().over(Window.partitionBy(*coarse).orderBy(*fine))
    placed = rows.withColumn("__nth", nth).join(groups, F.expr(" AND ".join(f"{c} <=> __g_{c}" for c in coarse)))
    return placed.withColumn(name, (F.col("__before") + F.col("__nth")).cast("long")).drop("__nth", "__before", *(f"__g_{c}" for c in coarse))


def page(rows: DataFrame, order: list[Column], number: str | int | None, size: int = 100) -> DataFrame:
    """One page of rows with its number; a page that isn't a number is the first, one past the end the last."""
    asked = int(number) if str(number or "").isdigit() and int(number) > 0 else 1
    last = max(1, -(-rows.count() // size))
    at = min(asked, last)
    return rows.orderBy(*order).offset((at - 1) * size).limit(size).withColumns({"page": F.lit(at).cast("long"), "pages": F.lit(last).cast("long")})


#: What is known of stored pages: the rows' schema, and how many each slice has.
_PAGED = "kind string, counts array<struct<slice: int, n: long>>"


def write_paged(rows: DataFrame, order: list[Column], path: str, slices: int | None = None) -> int:
    """Stores rows in slices by ranges of an order, each with its rows' places in it, and the slices' counts; gives the number of rows.

    The splitters come from a sample, so slices are about equal whatever the values; rows are sorted once, slice by slice. slices: how many; by default as many as shuffles have.
    """
    spark = rows.sparkSession
    # An id counts a partition's rows in its lower 33 bits.
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = rows.repartitionByRange(*([slices] if slices else []), *order).sortWithinPartitions(*order).withColumns({"__slice": F.spark_partition_id(), "__nth": nth})
    ranged.write.mode("overwrite").partitionBy("__slice").parquet(f"{path}/rows")
    kind = ranged.schema
    counts = sorted(map(tuple, spark.read.schema(kind).parquet(f"{path}/rows").groupBy("__slice").agg(F.count("*")).collect()))
    spark.createDataFrame([(kind.json(), counts)], _PAGED).coalesce(1).write.mode("overwrite").json(f"{path}/index")
    return sum(n for _, n in counts)


def read_page(spark: SparkSession, path: str, number: str | int | None, size: int = 100) -> DataFrame:
    """A page of what write_paged has stored, with place, page and pages: only the slices that hold it are read, and nothing is sorted.

    A page that isn't a number is the first, one past the end the last. One count for each slice reaches the driver.
    """
    index = spark.read.schema(_PAGED).json(f"{path}/index").first()
    counts = index["counts"]
    asked = int(number) if str(number or "").isdigit() and int(number) > 0 else 1
    last = max(1, -(-sum(n for _, n in counts) // size))
    low = (min(asked, last) - 1) * size
    before, found = 0, F.lit(False)
    place = F.lit(None).cast("long")
    for part, n in counts:
        if before < low + size and before + n > low:
            found = found | ((F.col("__slice") == part) & F.col("__nth").between(low - before, low + size - before - 1))
            place = F.when(F.col("__slice") == part, F.col("__nth") + before + 1).otherwise(place)
        before += n
    rows = spark.read.schema(StructType.fromJson(json.loads(index["kind"]))).parquet(f"{path}/rows").filter(found)
    return rows.withColumns({"place": place, "page": F.lit(min(asked, last)).cast("long"), "pages": F.lit(last).cast("long")}).drop("__slice", "__nth")


def root_heights(rows: DataFrame, series: list[str], value: str, floor: float = 1.0, height: float = 100.0) -> DataFrame:
    """Square-root heights by each series' own maximum; a positive value is floor at least."""
    most = F.max(value).over(Window.partitionBy(*series))
    return rows.withColumn("height", F.when(F.col(value) > 0, F.greatest(F.lit(floor), F.sqrt(F.col(value) / most) * height)).otherwise(0.0))


def log_widths(rows: DataFrame, value: str) -> DataFrame:
    """Logarithmic widths between 10 and 100 over all positive values."""
    positive = rows.filter(F.col(value) > 0)
    span = positive.agg(F.log10(F.min(value)).alias("low"), F.log10(F.max(value)).alias("high"))
    share = F.when(F.col("high") > F.col("low"), (F.log10(value) - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0)
    return positive.crossJoin(span).withColumn("width", 10 + 90 * share).drop("low", "high")


def two_sided_unit(rows: DataFrame, up: str, down: str, room_up: float, room_down: float) -> DataFrame:
    """The unit of a square-root scale that both sides fit with; zero without any value."""
    peaks = rows.agg(F.max(up).alias("u"), F.max(down).alias("d"))
    side = lambda room, c: F.when(F.col(c) > 0, F.lit(room) / F.sqrt(c))
    return peaks.select(F.coalesce(F.least(side(room_up, "u"), side(room_down, "d")), F.lit(0.0)).alias("unit"))
