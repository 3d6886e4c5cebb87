"""The Spark session that the library expects, and how its code gets to the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: Bytes of an Arrow batch where the session has no size of its own: rows of whole texts or sets are long, and a task and its worker each hold several batches.
BATCH_BYTES = 8 << 20
#: Scans of fewer bytes aren't worth dealing out.
SPREAD_BYTES = 4 << 20
#: Bytes of a table's files whose rows one task of a join sorts, so that a larger table has more tasks and none larger.
PIECE_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def session(app: str = "folioflow", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf adds to or replaces its settings."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", _BATCH: str(BATCH_BYTES), **conf}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def _file_bytes(df: DataFrame):
    """Bytes of the files of a table's scan, whichever of its columns are kept or worked out."""
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().head().stats().sizeInBytes()


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table's scan, dealt out over the cores by a key where it has fewer splits than there are cores, as one small file has.

    A scan that keeps all cores busy, as any large table's does, and one of less than SPREAD_BYTES stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if _file_bytes(df) < SPREAD_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, F.col(f"`{key}`"))


def in_pieces(large: DataFrame, key: str, other: DataFrame, other_key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join dealt out by their keys, to one task for each PIECE_BYTES of the larger one's files.

    Partitions that Spark merges to a size in shuffled bytes hold ten times as much once they are sorted. Sides that have
    no more pieces than there are cores stay as they are, so small ones may be broadcast. Keys must not be skewed.
    """
    pieces = -(-_file_bytes(large) // PIECE_BYTES)
    if pieces <= large.sparkSession.sparkContext.defaultParallelism:
        return large, other
    return large.repartition(pieces, F.col(f"`{key}`")), other.repartition(pieces, F.col(f"`{other_key}`"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where none is set and Spark is local."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioflow-checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder, with their lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application, for functions that run in Python there.

    A session that has set no size of its own for Arrow batches in bytes gets BATCH_BYTES.
    """
    context = spark.sparkContext
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='folioflow-')}/folioflow", "zip", root_dir=package.parent, base_dir=package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark
