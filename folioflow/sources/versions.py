"""Several tables in versions: a write changes all of them at once, or none.

A store is a folder. Tasks write Parquet files under ``data``, each write in a folder of its own; a version is a manifest under
``versions`` that names the files of every table, and the highest one is in force. A write is one Spark job over the rows of all
tables, and its commit on the driver publishes one manifest: readers have the old tables until then and the new
ones after. A task or job that fails leaves no manifest, and the abort deletes its files. A manifest
is created only if its number is still free, so of two writers from the same version one fails with Conflict.

A table's files are dealt by a bucket of its key, so that a merge reads and replaces the buckets it touches and no others. Rows of one bucket
are written by several tasks, as a salt of the whole row tells. A manifest also holds marks, (name, number), which tell what was
applied already: a batch of a stream that is run again, or a send that is finished.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from folioflow.session import ship

BUCKETS = 64
SALTS = 8


class Conflict(RuntimeError):
    """Another writer has published from the same version."""


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _manifests(files: fs.FileSystem, root: str) -> list[str]:
    found = files.get_file_info(fs.FileSelector(f"{root}/versions", allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.endswith(".json"))


def _manifest(path: str) -> dict:
    files, root = _file_system(path)
    found = _manifests(files, root)
    if not found:
        return {"version": 0, "tables": {}, "marks": {}}
    with files.open_input_stream(found[-1]) as stream:
        return json.loads(stream.read())


def _publish(path: str, manifest: dict) -> None:
    """Creates a version's manifest, whole, unless there is one."""
    files, root = _file_system(path)
    files.create_dir(f"{root}/versions")
    made, target = f"{root}/versions/.{uuid.uuid4().hex}", f"{root}/versions/{manifest['version']:020d}.json"
    with files.open_output_stream(made) as stream:
        stream.write(json.dumps(manifest).encode())
    try:
        if isinstance(files, fs.LocalFileSystem):
            os.link(made, target)  # fails if the target is there, which a move doesn't
            files.delete_file(made)
        else:
            files.move(made, target)
    except FileExistsError as error:
        files.delete_file(made)
        raise Conflict(f"version {manifest['version']} is there already") from error


@dataclass
class Written(WriterCommitMessage):
    """table, bucket and path of each file of a task."""

    files: list[tuple[str, int, str]]


class VersionWriter(DataSourceArrowWriter):
    """Writes rows (__table, __bucket, a struct for each table), sorted by table and bucket, as one file for each of these."""

    def __init__(self, options: dict) -> None:
        self.path, self.folder = options["path"], options["folder"]
        self.base, self.tables = json.loads(options["base"]), json.loads(options["tables"])
        self.marks = json.loads(options["marks"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _file_system(self.path)
        files.create_dir(f"{root}/{self.folder}")
        done: list[tuple[str, int, str]] = []
        held = writer = None
        for batch in iterator:
            at, names, buckets = 0, batch.column(0).to_pylist(), batch.column(1).to_pylist()
            while at < batch.num_rows:
                here, stop = (names[at], buckets[at]), at
                while stop < batch.num_rows and (names[stop], buckets[stop]) == here:
                    stop += 1
                struct = batch.column(batch.schema.get_field_index(here[0])).slice(at, stop - at)
                rows = pa.RecordBatch.from_arrays(struct.flatten(), schema=pa.schema(list(struct.type)))
                if here != held:
                    if writer:
                        writer.close()
                    held, name = here, f"{self.folder}/{uuid.uuid4().hex}.parquet"
                    writer = pq.ParquetWriter(f"{root}/{name}", rows.schema, filesystem=files)
                    done.append((*here, name))
                writer.write_batch(rows)
                at = stop
        if writer:
            writer.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        tables = {name: {**t} for name, t in self.base["tables"].items()}
        for name, change in self.tables.items():
            gone = set(change["replaced"])
            tables[name] = {"schema": change["schema"], "buckets": change["buckets"], "files": [f for f in tables.get(name, {"files": []})["files"] if f[0] not in gone]}
        for message in messages:
            for name, bucket, file in message.files if message else ():
                tables[name]["files"].append([bucket, file])
        _publish(self.path, {"version": self.base["version"] + 1, "tables": tables, "marks": {**self.base["marks"], **self.marks}})

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _file_system(self.path)
        if files.get_file_info(f"{root}/{self.folder}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.folder}")


class VersionSink(DataSource):
    """Used by publish."""

    @classmethod
    def name(cls) -> str:
        return "table_versions"

    def writer(self, schema: StructType, overwrite: bool) -> VersionWriter:
        return VersionWriter(self.options)


@dataclass
class Change:
    """Rows for a table. replaced: the buckets whose old rows go, None for those of all buckets; otherwise rows are added."""

    rows: DataFrame
    key: Column
    replaced: list[int] | None = ()


class Store:
    """A store as it is when this is made; what is read and written later refers to that version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.manifest = ship(spark), path, _manifest(path)

    @property
    def version(self) -> int:
        return self.manifest["version"]

    def mark(self, name: str) -> int | None:
        return self.manifest["marks"].get(name)

    def buckets(self, table: str) -> int:
        return self.manifest["tables"].get(table, {}).get("buckets", BUCKETS)

    def bucket(self, table: str, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets(table))).cast("int")

    def touched(self, table: str, rows: DataFrame, key: Column) -> list[int]:
        """The buckets that rows fall into: at most as many as the table has."""
        return sorted(r[0] for r in rows.select(self.bucket(table, key)).distinct().collect())

    def read(self, table: str, buckets: list[int] | None = None, schema: str | None = None) -> DataFrame:
        """A table's rows, or those of some buckets. schema: of a table that may not be there yet."""
        held = self.manifest["tables"].get(table)
        if held is None:
            if schema is None:
                raise ValueError(f"there is no table {table}")
            return self.spark.createDataFrame([], schema)
        kind = StructType.fromJson(json.loads(held["schema"]))
        files = [f"{self.path}/{file}" for bucket, file in held["files"] if buckets is None or bucket in set(buckets)]
        return self.spark.read.schema(kind).parquet(*files) if files else self.spark.createDataFrame([], kind)

    def publish(self, changes: dict[str, Change], marks: dict[str, int] | None = None) -> int:
        """Writes all changes as the next version and gives its number; a failure leaves the store as it was."""
        parts, tables = None, {}
        for name, change in changes.items():
            df = change.rows
            tables[name] = {"schema": df.schema.json(), "buckets": self.buckets(name), "replaced": list(range(self.buckets(name))) if change.replaced is None else list(change.replaced)}
            row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
            salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(SALTS))
            part = df.select(F.lit(name).alias("__table"), self.bucket(name, change.key).alias("__bucket"), salt.alias("__salt"), row.alias(name))
            parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
        dealt = parts.repartition("__table", "__bucket", "__salt").sortWithinPartitions("__table", "__bucket").drop("__salt")
        self.spark.dataSource.register(VersionSink)
        options = {"path": self.path, "folder": f"data/{uuid.uuid4().hex}", "base": json.dumps(self.manifest), "tables": json.dumps(tables), "marks": json.dumps(marks or {})}
        dealt.write.format("table_versions").mode("append").options(**options).save()
        self.manifest = _manifest(self.path)
        return self.version


def clear(path: str) -> int:
    """Deletes the folders of data that no manifest names: those of writers that were killed. To be called while nobody writes."""
    files, root = _file_system(path)
    used = set()
    for manifest in _manifests(files, root):
        with files.open_input_stream(manifest) as stream:
            used |= {f[1].split("/")[1] for t in json.loads(stream.read())["tables"].values() for f in t["files"]}
    gone = [f.path for f in files.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)) if f.base_name not in used]
    for folder in gone:
        files.delete_dir(folder)
    return len(gone)
