"""Arrow stream shards ``data-*.arrow`` as a Spark data source: one partition a shard.

    register(spark)
    spark.read.format("arrow_shards").option("columns", "__key__,jsonl").load(folder)

Columns that aren't wanted are named away with ``columns``, so images stay unread until they are scored.
"""

from __future__ import annotations

import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, S3, ...), and the path in it."""
    return fs.FileSystem.from_uri(folder)


def shard_files(folder: str) -> list[str]:
    """The shards below a folder, sorted; FileNotFoundError if there are none."""
    system, path = opened(folder)
    found = sorted(f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, "data-*.arrow"))
    if not found:
        raise FileNotFoundError(f"no data-*.arrow below {folder}")
    return found


def _batches(folder: str, path: str):
    """The schema of a shard, then its batches."""
    system = opened(folder)[0]
    with system.open_input_file(path) as f, pa.ipc.open_stream(f) as r:
        yield r.schema
        yield from r


def _schema(folder: str, columns: list[str] | None) -> pa.Schema:
    schema = next(_batches(folder, shard_files(folder)[0]))
    return pa.schema([x for x in schema if not columns or x.name in columns])


class ArrowShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_shards"

    def _columns(self):
        named = self.options.get("columns")
        return [c.strip() for c in named.split(",")] if named else None

    def schema(self):
        return from_arrow_schema(_schema(self.options["path"], self._columns()))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], shard_files(self.options["path"]), [f.name for f in schema.fields])


class _Reader(DataSourceReader):
    def __init__(self, folder: str, files: list[str], columns: list[str]):
        self.folder, self.files, self.columns = folder, files, columns

    def partitions(self):
        return [InputPartition(f) for f in self.files]

    def read(self, partition):
        batches = _batches(self.folder, partition.value)
        next(batches)
        for batch in batches:
            yield batch.select(self.columns)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowShards)


def write_shard(table: pa.Table, path: str) -> None:
    with pa.OSFile(path, "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
