"""A send in chunks that can be taken up again: what is sent is frozen first, and the ledger is written last.

A run lives in a folder: ``payload`` has its recipients with their chunks, written once and never made again; ``tries``
has a row for each chunk and attempt. Only when every chunk of the payload has been sent are the ledger and the
mark of the run written, each so that writing it twice changes nothing; a run that breaks off anywhere is taken up by
calling the same functions again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.digest import chunks
from folioflow.operators.rollups import n_if, total
from folioflow.sources.sinks import append_new, exists
from folioflow.sources.versions import Change, Store

TRIES = "chunk long, attempt long, ok boolean, error string"


def freeze(recipients: DataFrame, path: str, size: int = 100) -> DataFrame:
    """The frozen payload: recipients (id and what else they have) with their chunks. If there is one, it is given back as it is."""
    spark = recipients.sparkSession
    if not exists(spark, f"{path}/payload/_SUCCESS"):
        chunks(recipients, size).write.mode("overwrite").parquet(f"{path}/payload")
    return spark.read.parquet(f"{path}/payload")


def tries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIES).parquet(f"{path}/tries") if exists(spark, f"{path}/tries") else spark.createDataFrame([], TRIES)


def to_send(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the payload whose chunk hasn't been sent yet."""
    done = tries(spark, path).filter("ok").select("chunk").distinct()
    return spark.read.parquet(f"{path}/payload").join(done, "chunk", "left_anti")


def record(results: DataFrame, path: str) -> None:
    """Adds what became of chunks: chunk, ok, error. Attempts are counted on from those before."""
    before = tries(results.sparkSession, path).groupBy("chunk").agg(F.max("attempt").alias("before"))
    numbered = results.join(before, "chunk", "left").select(F.col("chunk").cast("long").alias("chunk"), (F.coalesce("before", F.lit(0)) + 1).cast("long").alias("attempt"), "ok", "error")
    numbered.write.mode("append").parquet(f"{path}/tries")


def run_states(attempts: DataFrame, wanted: Column) -> DataFrame:
    """Each run's chunks: a chunk is done once an attempt of it was. attempts: run, chunk, attempt, ok; wanted: how many chunks a run has."""
    per = attempts.groupBy("run", "chunk").agg(F.max("ok").alias("ok"), F.count("*").alias("attempts"))
    out = per.groupBy("run").agg(F.count("*").alias("chunks"), n_if(F.col("ok")).alias("done"), total(F.col("attempts")).alias("attempts"))
    return out.withColumn("status", F.when(F.col("done") == wanted, "sent").otherwise("failed"))


def finalise(spark: SparkSession, path: str, filings: DataFrame, ledger: str, sends: str, run: str) -> str:
    """Writes the ledger (url) and the sends (id, run) once all chunks are done; gives the run's status: sent, or failed with nothing written."""
    payload = spark.read.parquet(f"{path}/payload")
    if not to_send(spark, path).isEmpty():
        return "failed"
    append_new(filings.select("url"), ledger, ["url"])
    append_new(payload.select("id", F.lit(run).alias("run")), sends, ["id", "run"])
    spark.createDataFrame([(run, "sent")], "run string, status string").coalesce(1).write.mode("overwrite").json(f"{path}/status")
    return "sent"


LEDGER, SENDS = "ledger", "sends"


def finalise_at_once(spark: SparkSession, path: str, filings: DataFrame, store: str, run: str) -> str:
    """As finalise, with ledger and sends as tables of one store: readers see both with the run's rows, or neither.

    The run's mark is part of the same version, so a run that is finished twice adds nothing, and one that fails in any task changes nothing.
    """
    held = Store(spark, store)
    if held.mark(f"run {run}") is not None:
        return "sent"
    payload = spark.read.parquet(f"{path}/payload")
    if not to_send(spark, path).isEmpty():
        return "failed"
    known = held.read(LEDGER, schema="url string").distinct()
    urls = filings.select("url").distinct().alias("a").join(known.alias("b"), F.expr("a.url <=> b.url"), "left_anti")
    held.publish({LEDGER: Change(urls, F.col("url")), SENDS: Change(payload.select("id", F.lit(run).alias("run")), F.col("id"))}, {f"run {run}": 1})
    return "sent"
