"""Writers: quoted text files, nested documents that keep their stamp, keyed states and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The columns of the summary of officials, in order.
SUMMARY = (
    "name", "slug", "title", "agency", "level", "confirmed_date", "departed_date", "transaction_count", "sales_count", "purchases_count",
    "late_filing_count", "estimated_total_value", "most_recent_oge_filing_date",
)


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV with quotes where a cell has a comma, a quote or a line's end, or around every cell; nulls are empty."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', quoteAll=quote_all, nullValue="", emptyValue="").csv(path)


def transactions_csv(rows: DataFrame, path: str) -> None:
    late = F.when(F.col("late"), "yes").otherwise("no")
    write_csv(rows.withColumn("late_filing", late).drop("late"), path)


#: A stamped table's mark: the hash of its rows, empty while they are written, and the stamp.
META = "content string, stamp string"


def officials_csv(summary: DataFrame, path: str) -> None:
    """The summary of officials with its thirteen columns; missing dates are empty."""
    write_csv(summary.select(*SUMMARY), path)


def write_dataset(nested: DataFrame, path: str, stamp: str) -> str:
    """The nested export, one document for each official with its transactions, and its totals beside it.

    Totals are written first; the stamp of an unchanged dataset stays, and so do its files.
    """
    sums = nested.agg(F.count("*").alias("officialCount"), F.coalesce(F.sum("transactionCount"), F.lit(0)).cast("long").alias("transactionCount"))
    sums.coalesce(1).write.mode("overwrite").json(f"{path}/totals")
    return write_stamped(nested, path, stamp)


def content_hash(df: DataFrame) -> str:
    """A hash of the rows, whatever their order and partitions."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    row = df.select(F.xxhash64(F.to_json(F.struct(*columns))).cast("decimal(38,0)").alias("h")).agg(F.sum("h"), F.count("*")).first()
    return f"{row[0]}:{row[1]}"


def write_stamped(df: DataFrame, path: str, stamp: str) -> str:
    """Writes rows with a stamp as JSON; if what is there has the same rows, its stamp is kept. Gives the stamp in force.

    The old mark is put out of force before the rows are overwritten and the new one is written after them, so a run that
    breaks off leaves rows without a mark, which the next run writes again, and never rows under another's stamp.
    """
    spark = df.sparkSession
    new = content_hash(df)
    if exists(spark, f"{path}/_meta"):
        old = spark.read.schema(META).json(f"{path}/_meta").first()
        if old and old["content"] == new:
            return old["stamp"]
    mark = lambda content: spark.createDataFrame([(content, stamp)], META).coalesce(1).write.mode("overwrite").json(f"{path}/_meta")
    mark("")
    df.write.mode("overwrite").json(f"{path}/rows")
    mark(new)
    return stamp


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path's own file system has it; nothing is listed or opened."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_dated(df: DataFrame, path: str, dry_run: bool = False) -> int:
    """Replaces the partitions of the dates in df, and no others."""
    n = df.count()
    if not dry_run:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    return n


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Appends rows whose key the table doesn't have; a second run adds nothing. Null keys equal each other."""
    spark = df.sparkSession
    once = df.dropDuplicates(key)
    if exists(spark, path):
        same = F.expr(" AND ".join(f"a.`{k}` <=> b.`{k}`" for k in key))
        once = once.alias("a").join(spark.read.parquet(path).select(*key).alias("b"), same, "left_anti")
    once.write.mode("append").parquet(path)


def reload_tables(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Clears and reloads tables, in the given order, each from its source; gives their counts.

    A table is written beside the one in force and named in a pointer that is overwritten last, so that readers have the
    old tables until all new ones are whole, and an interrupted run changes nothing.
    """
    spark = next(iter(tables.values())).sparkSession
    number = max([int(r["version"]) for r in _pointer(spark, path)], default=0) + 1
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/v{number}/{name}")
        counts[name] = spark.read.parquet(f"{path}/v{number}/{name}").count()
    spark.createDataFrame([(number,)], "version long").coalesce(1).write.mode("append").json(f"{path}/_versions")
    return counts


def _pointer(spark: SparkSession, path: str) -> list:
    return spark.read.schema("version long").json(f"{path}/_versions").agg(F.max("version").alias("version")).filter("version IS NOT NULL").collect() if exists(spark, f"{path}/_versions") else []


def loaded(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as the last whole reload left it."""
    return spark.read.parquet(f"{path}/v{_pointer(spark, path)[0]['version']}/{name}")


def write_state(df: DataFrame, path: str) -> None:
    """Overwrites a small state of one row."""
    df.coalesce(1).write.mode("overwrite").json(path)


def tables(spark: SparkSession, database: str = "default") -> DataFrame:
    """Tables and columns of a catalogue."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")
