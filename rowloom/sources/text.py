"""Text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.operators.row_index import IndexedScan, count_blocks, index_blocks, position_columns


def scan_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per line; ``\\n``, ``\\r\\n`` and a lone ``\\r`` all end a line."""
    return spark.read.text(path)


def index_text(spark: SparkSession, path: str | list[str]) -> IndexedScan:
    """Columns value, row_idx, plus the position columns."""
    lines = scan_text(spark, path)
    blocks = count_blocks(lines.select(*position_columns()))
    return index_blocks(lines.select("value", *position_columns()), blocks)
