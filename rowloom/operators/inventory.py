"""File trees: filter by patterns, count, and find what is still to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.expressions import ancestors, matches_any
from rowloom.sinks.manifest import MANIFEST, finished_outputs
from rowloom.sources.files import exists, files_below, read_small_text

# Patterns left out when a tree names none, and the files that may name some.
DEFAULT_EXCLUDES = (
    ".git",
    ".venv",
    "venv",
    "__pycache__",
    "*.pyc",
    "*.egg-info",
    "node_modules",
    ".mypy_cache",
    ".pytest_cache",
    ".DS_Store",
    ".ipynb_checkpoints",
)
IGNORE_FILES = (".gcloudignore", ".dockerignore", ".gitignore")


def ignore_patterns(spark: SparkSession, directory: str, extra: Sequence[str] = ()) -> list[str]:
    """Patterns of the first ignore file the tree has, else the defaults; ``extra`` always added."""
    base = directory.rstrip("/")
    named = next((f"{base}/{name}" for name in IGNORE_FILES if exists(spark, f"{base}/{name}")), None)
    if named is None:
        return [*DEFAULT_EXCLUDES, *extra]
    lines = [line.strip() for line in read_small_text(spark, named).splitlines()]
    return [line for line in lines if line and not line.startswith("#")] + list(extra)


def exclude_paths(df: DataFrame, patterns: Sequence[str], column: str = "rel_path") -> DataFrame:
    """Drop rows whose path, one of its parents or one of its parts fits a shell pattern."""
    return df.filter(~matches_any(F.col(column), patterns))


def file_inventory(
    spark: SparkSession, directory: str, extra: Sequence[str] = (), patterns: Sequence[str] | None = None
) -> DataFrame:
    """Files of a tree (path, rel_path, length, modified) after the exclude patterns.

    Contents are not read, and excluded directories are not opened.  The manifest that this library
    keeps of its own shards is no file of the tree.
    """
    chosen = ignore_patterns(spark, directory, extra) if patterns is None else [*patterns, *extra]
    chosen = [*chosen, MANIFEST]
    return exclude_paths(files_below(spark, directory, patterns=chosen), chosen)


def inventory_totals(files: DataFrame) -> DataFrame:
    """One row: file_count, total_bytes."""
    total = F.coalesce(F.sum("length"), F.lit(0)).cast("bigint")
    return files.agg(F.count("*").alias("file_count"), total.alias("total_bytes"))


def pending_outputs(
    spark: SparkSession, expected: DataFrame, directory: str, column: str = "rel_path", finished: str = "", manifest: bool = False
) -> DataFrame:
    """Rows of ``expected`` whose relative output path does not exist below ``directory``.

    A path exists when it is a file there or a directory that holds files.  With
    ``finished``, the name of the file that closes an output directory (such as
    ``_SUCCESS``), a directory counts only when it holds that file itself: one that is half
    written stays pending.  With ``manifest``, for shards that this library writes, an output counts
    only when the manifest of the write names it and its files still have the number and size
    given there.  Catalyst picks the join; neither side passes through the driver.
    """
    wanted = F.rtrim(F.col(column), F.lit("/"))
    if manifest:
        whole = finished_outputs(spark, directory).select(F.col("rel_path").alias("_done"))
        return expected.join(whole, wanted == F.col("_done"), "left_anti")
    done = ancestors(F.col("rel_path"))
    if finished:
        folder = F.regexp_extract("rel_path", "^(?s)(.*)/", 1)
        closed = F.substring_index("rel_path", "/", -1) == finished
        done = F.when(closed, F.array("rel_path", folder)).otherwise(F.array("rel_path"))
    listed = files_below(spark, directory).select(F.explode(done).alias("_done")).distinct()
    return expected.join(listed, wanted == F.col("_done"), "left_anti")


def changed_only(current: DataFrame, recorded: DataFrame, on: Sequence[str] = ("shard_id", "fingerprint")) -> DataFrame:
    """Rows of ``current`` whose key and fingerprint were not recorded before."""
    return current.join(recorded.select(*on), list(on), "left_anti")
