"""Filings that come as a stream, merged into a table so that every key is there as often as in the filing that has it most.

The store keeps, beside the merged rows, how often each filing has listed each key so far: a filing may come in several batches, and
a later batch of it raises what the key is to have. Rows, counts and the batch's number become one version, so that a batch that is run
again, whether it broke off before or after its version, adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.operators.merging import row_key
from folioflow.session import cut
from folioflow.sources.versions import Change, Store

ROWS, FILED, LOG = "rows", "filed", "amendments"
FILED_SCHEMA = "key string, filing string, n long"


def start(rows: DataFrame, path: str) -> None:
    """A store with the rows that exist already; if there is one, it stays."""
    store = Store(rows.sparkSession, path)
    if not store.version:
        store.publish({ROWS: Change(rows, row_key(), None)})


def amend(batch: DataFrame, batch_id: int, path: str, log: str = LOG) -> int:
    """Merges a batch of filings' rows: description, date, type, amount, filing, line. Gives the version in force.

    Of a key's rows in the batch those of the smallest filing and line are added, as many as are missing.
    log: names the stream whose batches are counted; a query with a checkpoint of its own needs a name of its own.
    """
    spark = batch.sparkSession
    store = Store(spark, path)
    done = store.mark(log)
    if done is not None and batch_id <= done:
        return store.version
    keyed = cut(batch.withColumn("__key", row_key()))
    key = F.col("__key")
    touched = store.touched(ROWS, keyed, key)
    if not touched:
        return store.version
    old_counts = store.read(FILED, touched, FILED_SCHEMA)
    new_counts = keyed.groupBy(key.alias("key"), F.col("filing").cast("string").alias("filing")).agg(F.count("*").alias("n"))
    counts = old_counts.unionByName(new_counts).groupBy("key", "filing").agg(F.sum("n").alias("n"))
    want = counts.groupBy("key").agg(F.max("n").alias("want"))
    have = store.read(ROWS, touched).groupBy(row_key().alias("key")).agg(F.count("*").alias("have"))
    missing = want.join(have, "key", "left").select(F.col("key").alias("__key"), (F.col("want") - F.coalesce("have", F.lit(0))).alias("__missing")).filter("__missing > 0")
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("filing", "line", *sorted(set(batch.columns) - {"filing", "line"})))
    added = keyed.join(missing, "__key").withColumn("__nth", nth).filter("__nth <= __missing").select(*batch.columns)
    return store.publish({ROWS: Change(added, row_key()), FILED: Change(counts, F.col("key"), touched)}, {log: batch_id})


def writer(path: str, log: str = LOG) -> Callable[[DataFrame, int], None]:
    """For foreachBatch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        amend(batch, batch_id, path, log)

    return write


def merged(spark: SparkSession, path: str) -> DataFrame:
    return Store(spark, path).read(ROWS)
