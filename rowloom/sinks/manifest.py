"""What a finished write left in a folder: one row per shard, written after all files are there.

A shard counts as finished only if the manifest names it and its files still have the number and
size that the manifest gives.  Half-written shards, of whatever writer, are in no manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.sources.files import exists, files_below

# Readers and shard directories skip hidden names.
MANIFEST = ".shard-manifest"
SCHEMA = "rel_path string, files bigint, bytes bigint, rows bigint, digest string"


def visible(rel):
    """Paths with no hidden part."""
    return ~F.exists(F.split(rel, "/"), lambda part: part.startswith(".") | part.startswith("_"))


def shard_sizes(spark: SparkSession, directory: str) -> DataFrame:
    """Files and bytes of every entry directly in ``directory``, with a digest of the names and lengths in it."""
    files = files_below(spark, directory).where(visible(F.col("rel_path")))
    entry = F.substring_index("rel_path", "/", 1)
    inside = F.concat_ws(":", F.octet_length("rel_path").cast("string"), "rel_path", F.col("length").cast("string"))
    return files.groupBy(entry.alias("rel_path")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(inside)), "\n"), 256).alias("digest"),
    )


def record_directories(spark: SparkSession, path: str, listed: str, fmt: str) -> None:
    """Write the manifest of the shard directories in ``listed`` below ``path`` (both are one folder but for a replacement).

    ``rows`` is known for Parquet, whose footers have it; it is null for other formats.
    """
    sizes = shard_sizes(spark, listed).where(F.col("rel_path").startswith("shard_id="))
    if fmt == "parquet":
        counts = spark.read.parquet(listed).groupBy("shard_id").agg(F.count("*").alias("rows"))
        counts = counts.select(F.concat(F.lit("shard_id="), F.col("shard_id").cast("string")).alias("rel_path"), "rows")
        sizes = sizes.join(counts, "rel_path", "left")
    else:
        sizes = sizes.withColumn("rows", F.lit(None).cast("bigint"))
    sizes.select("rel_path", "files", "bytes", "rows", "digest").coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")


def read_manifest(spark: SparkSession, directory: str) -> DataFrame:
    """Rows (rel_path, files, bytes, rows, digest) of all writes to ``directory``; none if there is no manifest."""
    path = f"{directory.rstrip('/')}/{MANIFEST}"
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def finished_outputs(spark: SparkSession, directory: str) -> DataFrame:
    """``rel_path`` of every shard of ``directory`` that is as its manifest says."""
    same = ["rel_path", "files", "bytes"]
    found = shard_sizes(spark, directory).select(*same)
    return found.join(read_manifest(spark, directory).select(*same).distinct(), same, "left_semi").select("rel_path")
