"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.session import checkpoint_dir as ensure_checkpoint_dir  # noqa: F401
from folioflow.session import cut, spread  # noqa: F401

#: A word is a maximal run of characters other than these (fixed by the result contracts).
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, {"documents": "doc_id", "pages": "page_id"}[name]) if name in ("documents", "pages") else df


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store Spark has it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def id_remainder(id_col: str, modulus: int) -> Column:
    """The remainder of crc32 of an id's text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def bounded_sample(df: DataFrame, n: int) -> DataFrame:
    """At most n rows of df, those that hash among the n smallest: the same rows in every run.

    Hashes are of whole rows, and at most n + 1 of them reach the driver. Of equal rows beyond the bound any are as good.
    """
    hashed = df.withColumn("__h", F.xxhash64(F.lit(7), *(F.col(f"`{c}`") for c in df.columns)))
    least = [r[0] for r in hashed.select("__h").orderBy("__h").limit(n + 1).collect()]
    if not least:
        return df.limit(0)
    last = least[min(n, len(least)) - 1]
    if len(least) <= n or least[n] > last:
        return hashed.filter(F.col("__h") <= last).drop("__h")
    ties = hashed.filter(F.col("__h") == last).limit(sum(h == last for h in least[:n]))
    return hashed.filter(F.col("__h") < last).union(ties).drop("__h")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, giving the memory that its task has freed back to the system: workers wait for their next task with what they hold."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied
