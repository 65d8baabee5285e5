"""The list of shards a split would make, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.expressions import check_sizes, shard_name


def shard_plan(spark: SparkSession, total: int, n: int, stem: str = "part", suffix: str = "") -> DataFrame:
    """One row per shard: shard_id, row_start, row_count, shard_name."""
    check_sizes(total, n)
    base = F.lit(total // n).cast("bigint")
    extra = F.when(F.col("id") == n - 1, F.lit(total % n)).otherwise(F.lit(0)).cast("bigint")
    shard_id = F.col("id").cast("int")
    return spark.range(n).select(
        shard_id.alias("shard_id"),
        (F.col("id") * base).alias("row_start"),
        (base + extra).alias("row_count"),
        shard_name(stem, shard_id, suffix).alias("shard_name"),
    )
