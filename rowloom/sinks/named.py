"""Shard files under names of their own, written and put in place by the tasks.

A data source whose writer gives every partition one file in a hidden folder of the target.  When
all are written, a second job moves them to their names, each file by a task; the driver touches
neither.  A job that fails leaves the target as it was; a killed task leaves at most a file in the
hidden folder, which goes when the job ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from rowloom.functions.tasks import move_files, open_filesystem, write_shard_file
from rowloom.sinks.manifest import MANIFEST
from rowloom.sources.files import qualified


@dataclass
class Written(WriterCommitMessage):
    """One shard file: name, rows, bytes, sha256."""

    row: tuple


class NamedShards(DataSource):
    """Options: folder (hidden, to write to), stem, suffix, kind (text or parquet)."""

    @classmethod
    def name(cls) -> str:
        return "rowloom_named_shards"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NamedWriter(dict(self.options))


class NamedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        name = f"{self.options['stem']}.shard{shard:04d}{self.options['suffix']}"
        return Written(write_shard_file(iterator, self.options["folder"], name, self.options["kind"]))

    def commit(self, messages: list) -> None:
        """One small file with a row per shard; it becomes the manifest."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        rows = [m.row for m in messages if m is not None]
        names = ["rel_path", "files", "bytes", "rows", "digest"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        filesystem, inner = open_filesystem(self.options["folder"])
        with filesystem.open_output_stream(f"{inner}/manifest.parquet") as out:
            pq.write_table(table, out)

    def abort(self, messages: list) -> None:
        filesystem, inner = open_filesystem(self.options["folder"])
        filesystem.delete_dir(inner)


def tasks_can_write(path: str) -> bool:
    """Do tasks know the scheme of ``path``?"""
    try:
        open_filesystem(path)
    except Exception:
        return False
    return True


def write_named(df: DataFrame, n: int, target: str, stem: str, suffix: str, kind: str, replace: bool) -> None:
    """Write partition k of ``df`` to ``target/stem.shardKKKK suffix``; adds them to the manifest.

    ``df`` has ``n`` partitions.  Files of the same names are replaced, or refused without ``replace``.
    """
    spark = df.sparkSession
    base = qualified(spark, target)
    hidden = f"{base}/.rowloom-{uuid.uuid4().hex}"
    filesystem, inner = open_filesystem(hidden)
    filesystem.create_dir(inner, recursive=True)
    spark.dataSource.register(NamedShards)
    try:
        df.write.format(NamedShards.name()).mode("append").options(folder=hidden, stem=stem, suffix=suffix, kind=kind).save()
        rows = spark.range(0, n, 1, min(n, 4 * spark.sparkContext.defaultParallelism))
        moved = rows.mapInArrow(move_files(hidden, base, stem, suffix, replace), "moved bigint")
        moved.write.format("noop").mode("append").save()
        manifest = f"{open_filesystem(base)[1]}/{MANIFEST}"
        filesystem.create_dir(manifest, recursive=True)
        filesystem.move(f"{inner}/manifest.parquet", f"{manifest}/part-{uuid.uuid4().hex}.parquet")
    finally:
        if filesystem.get_file_info(inner).type != fs.FileType.NotFound:
            filesystem.delete_dir(inner)
