"""Parquet tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators.row_index import (
    BASE,
    FILE,
    IndexedScan,
    before,
    block_sizes,
    count_blocks,
    files_of,
    position_columns,
    refuse_reserved,
    rises,
    side_bytes,
    widest,
)
from rowloom.scratch import BROADCAST_BYTES, small_side


def scan_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def index_parquet(spark: SparkSession, path: str | list[str]) -> IndexedScan:
    """All columns, row_idx and the file.

    The row number inside the file comes from the reader, so filters on the result still
    reach the scan; the counting job reads file footers only.  Several files need an
    offset per file, a single file needs no join.
    """
    table = scan_parquet(spark, path)
    refuse_reserved(table)
    blocks = count_blocks(table.select(*position_columns()))
    total, in_order = int(blocks["rows"].sum()), rises(blocks["min_m"])
    placed = table.select(
        "*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias("row_idx")
    )
    files = blocks.groupby(FILE, as_index=False, sort=False)["rows"].sum()
    if len(files) > 1:
        files = files.assign(**{BASE: before(files["rows"])})[[FILE, BASE]]
        size = side_bytes(len(files), files[FILE])
        side = spark.createDataFrame(pa.Table.from_pandas(files, preserve_index=False))
        placed = (
            placed.join(small_side(side, size), FILE)
            .withColumn("row_idx", F.col("row_idx") + F.col(BASE))
            .select(*table.columns, FILE, "row_idx")
        )
        in_order = in_order and size <= BROADCAST_BYTES
    return IndexedScan(placed, total, in_order, widest(blocks) if total else 0, files_of(blocks), block_sizes(blocks, before(blocks["rows"])))
