"""File listings as DataFrames, and the few path questions the driver has to ask."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import tasks
from rowloom.functions.expressions import path_regexes
from rowloom.scratch import new_scratch

LISTING = "path string, rel_path string, length bigint, modified timestamp"
# Directories that the first task of a walk, and every later one, opens before the rest is dealt out anew.
FIRST_OPENED, OPENED = 64, 4096


def _hadoop(spark: SparkSession, path: str):
    """(FileSystem, Path) of the connector that serves ``path``."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def qualified(spark: SparkSession, path: str) -> str:
    """Absolute path with scheme, spelled as Spark's listings spell it."""
    filesystem, jvm_path = _hadoop(spark, path)
    return filesystem.makeQualified(jvm_path).toString().rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    filesystem, jvm_path = _hadoop(spark, path)
    return filesystem.exists(jvm_path)


def read_small_text(spark: SparkSession, path: str) -> str:
    """Whole content of a small settings file (dotfiles included, which readers skip)."""
    filesystem, jvm_path = _hadoop(spark, path)
    stream = filesystem.open(jvm_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_files(spark: SparkSession, directory: str, suffix: str = "", recursive: bool = True) -> DataFrame:
    """Regular files below ``directory`` whose path ends with ``suffix``, in path order.

    Empty files and hidden names are listed; tasks walk the directories in parallel.  A
    directory that does not exist gives an empty frame.  A store that the tasks cannot list
    raises: Spark's own listing leaves out empty files and hidden names.
    """
    return files_below(spark, directory, recursive).filter(F.col("path").endswith(suffix)).orderBy("path")


def files_below(spark: SparkSession, directory: str, recursive: bool = True, patterns: Sequence[str] = ()) -> DataFrame:
    """``list_files`` in no order, without what lies below directories that fit one of ``patterns``."""
    return walked(spark, directory, recursive, patterns).where("kind = 'file'").drop("kind")


def walked(spark: SparkSession, directory: str, recursive: bool = True, patterns: Sequence[str] = ()) -> DataFrame:
    """A walk of a tree: rows of kind "file" and, for every directory that was listed, "opened".

    The walk goes in rounds. A round's directories are a table dealt to tasks; a task goes down
    from its own up to a number of directories and gives back those it did not come to, which the
    next round deals out anew, so that deep and lopsided trees spread. Directories whose path or
    name fits one of ``patterns`` are not opened. Rounds are written to the shared folder; the
    driver gets no more of them than a count.
    """
    schema = "kind string, " + LISTING
    if not exists(spark, directory):
        return spark.createDataFrame([], schema)
    base = qualified(spark, directory)
    tasks.open_filesystem(base)
    most = 4 * spark.sparkContext.defaultParallelism
    place, rounds = new_scratch(spark, "walk"), []
    frontier, budget = spark.createDataFrame([("",)], "rel_path string"), FIRST_OPENED
    while True:
        rounds.append(f"{place}/{len(rounds)}")
        frontier.mapInArrow(tasks.tree_walker(base, budget, path_regexes(patterns), recursive), schema).write.parquet(rounds[-1])
        left = spark.read.schema(schema).parquet(rounds[-1]).where("kind = 'left'").select("rel_path")
        count = left.count()
        if not count:
            return spark.read.schema(schema).parquet(*rounds).where("kind <> 'left'")
        frontier, budget = left.repartition(min(count, most), "rel_path"), OPENED


def holds(spark: SparkSession, directory: str, *patterns: str) -> list[str]:
    """Paths directly in ``directory`` whose names fit one of the shell patterns."""
    if not exists(spark, directory):
        return []
    filesystem, jvm_path = _hadoop(spark, directory)
    found = [s.getPath() for s in filesystem.listStatus(jvm_path)]
    return [p.toString() for p in found if any(fnmatchcase(p.getName(), pattern) for pattern in patterns)]


def name_parts(spark: SparkSession, folder: str, target: str, names: Sequence[str], replace: bool) -> None:
    """Move part file k of ``folder`` to ``target`` under the k-th name; the folder goes."""
    filesystem, jvm_path = _hadoop(spark, folder)
    for status in filesystem.listStatus(jvm_path):
        number = re.match(r"part-(\d+)-", status.getPath().getName())
        if number is None:
            continue
        wanted = _hadoop(spark, f"{target}/{names[int(number[1])]}")[1]
        if replace and filesystem.exists(wanted):
            filesystem.delete(wanted, False)
        if filesystem.exists(wanted) or not filesystem.rename(status.getPath(), wanted):
            raise FileExistsError(f"{wanted.toString()} cannot be written")
    filesystem.delete(jvm_path, True)


def private_copy(spark: SparkSession, path: str, target: str, most_bytes: int) -> tuple[str, bool]:
    """Copy a file or folder of at most ``most_bytes`` into the folder ``target``; its new path, is it a folder."""
    filesystem, jvm_path = _hadoop(spark, path.rstrip("/"))
    size = filesystem.getContentSummary(jvm_path).getLength()
    if size > most_bytes:
        raise ValueError(f"{path} has {size} bytes, more than {most_bytes}: read it as a table and join it")
    to_filesystem, to_path = _hadoop(spark, f"{target}/{uuid.uuid4().hex}-{jvm_path.getName()}")
    conf = spark._jsc.hadoopConfiguration()
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(filesystem, jvm_path, to_filesystem, to_path, False, conf)
    return to_path.toString(), filesystem.getFileStatus(jvm_path).isDirectory()
