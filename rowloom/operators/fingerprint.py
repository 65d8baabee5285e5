"""Content fingerprints of tables, shards and file trees.

Each row (or piece of a file) has a sha256; eight 32-bit words of it are summed.  Sums
merge in any order, so the work is one pass with a partial aggregate per task: no sort, no
shuffle of data, no group that grows, and equal rows still count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import tasks
from rowloom.functions.expressions import pair_digest, row_digest
from rowloom.operators.inventory import file_inventory
from rowloom.scratch import checkpointed

WORDS = 8
PIECE_BYTES = 64 << 20  # part of the definition: files are hashed in pieces of this size


def fingerprint(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """``by`` columns, row_count and fingerprint (hex) of the rows, in any order.

    Equal contents give equal values whatever the partitioning.
    """
    chosen = columns or [c for c in df.columns if c not in by]
    digest = row_digest([df.schema[c] for c in chosen])
    return _summed(df.select(*by, digest.alias("_digest")), by)


def _summed(digests: DataFrame, by: Sequence[str]) -> DataFrame:
    words = [f"_w{i}" for i in range(WORDS)]
    numbers = [
        F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("bigint").alias(w) for i, w in enumerate(words)
    ]
    # A task's rows fit a bigint sum of 32-bit words; the sum over tasks is a decimal.
    per_task = (
        digests.select(*by, *numbers)
        .groupBy(*by, F.spark_partition_id().alias("_task"))
        .agg(F.count("*").alias("_rows"), *[F.sum(w).alias(w) for w in words])
    )
    totals = per_task.groupBy(*by).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("row_count"),
        *[F.coalesce(F.sum(F.col(w).cast("decimal(28,0)")), F.lit(0)).cast("string").alias(w) for w in words],
    )
    value = F.sha2(F.concat_ws(":", F.col("row_count").cast("string"), *words), 256)
    return totals.select(*by, "row_count", value.alias("fingerprint"))


def file_digests(files: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """sha256 of every piece of every listed file: rel_path, piece, digest.

    A large file is many pieces, spread over the tasks; a task holds one megabyte of it.
    """
    spark = files.sparkSession
    last = F.greatest(F.call_function("div", F.col("length") - 1, F.lit(piece_bytes).cast("bigint")), F.lit(0).cast("bigint"))
    pieces = files.select("path", "rel_path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    offset = F.col("piece") * F.lit(piece_bytes).cast("bigint")
    ranges = pieces.select(
        "path", "rel_path", "piece", offset.alias("offset"),
        F.least(F.col("length") - offset, F.lit(piece_bytes).cast("bigint")).alias("size"),
    )
    spread = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rel_path", "piece")
    return spread.mapInPandas(tasks.hash_pieces, "rel_path string, piece bigint, digest string")


def fingerprint_tree(
    spark: SparkSession,
    directory: str,
    extra: Sequence[str] = (),
    patterns: Sequence[str] | None = None,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """One row for a file tree after the exclude patterns: file_count, total_bytes, fingerprint.

    Depends on relative paths and contents alone.  A tree with nothing left is an error.
    """
    files = checkpointed(file_inventory(spark, directory, extra, patterns))
    totals = files.agg(F.count("*").alias("file_count"), F.sum("length").alias("total_bytes")).first()
    if not totals.file_count:
        raise ValueError(f"no files in {directory} after the exclude patterns")
    digests = file_digests(files, piece_bytes)
    entry = pair_digest(F.col("rel_path"), F.concat_ws(":", F.col("piece").cast("string"), "digest"))
    return _summed(digests.select(entry.alias("_digest")), ()).select(
        F.lit(totals.file_count).cast("bigint").alias("file_count"),
        F.lit(totals.total_bytes).cast("bigint").alias("total_bytes"),
        "fingerprint",
    )
