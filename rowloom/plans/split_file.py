"""Split one file, or a directory of files of one format, into shards on disk."""

from __future__ import annotations

import posixpath
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.expressions import check_sizes, output_path
from rowloom.operators.split import split_contiguous
from rowloom.plans.shard_plan import shard_plan
from rowloom.sinks.named import tasks_can_write
from rowloom.sinks.replace import refuse_sources_in
from rowloom.sinks.shards import write_csv_records, write_named_shards, write_shards
from rowloom.sources.csv import index_csv
from rowloom.sources.files import holds, name_parts, qualified
from rowloom.sources.formats import FORMATS, detect_format
from rowloom.sources.parquet import index_parquet
from rowloom.sources.text import index_text

# Endings of shard files whose source names none that fits.
ENDINGS = {"text": ".txt", "csv": ".csv", "parquet": ".parquet"}
# Endings by which readers would unpack what is written plainly.
PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def split_file(
    spark: SparkSession,
    path: str,
    n: int,
    out_dir: str,
    fmt: str = "auto",
    multi_line: bool = True,
    rows_per_file: int = 1_000_000,
    mode: str = "errorifexists",
    one_file: bool = False,
) -> DataFrame:
    """Write ``n`` shards of ``path`` below ``out_dir``; returns the plan with each shard's path.

    Row order is kept, CSV shards repeat the header, Parquet shards keep the schema.  Sizes
    are checked before anything is written.  Shards that are there already are refused
    unless ``mode="overwrite"``, which replaces the folder; a folder with the source in it
    is never replaced.

    ``one_file=True`` writes each shard as one file ``stem.shardNNNN.ext`` directly in
    ``out_dir``, ready for ``scan_shard_dir``; shards are then the unit of work, so choose
    ``n`` to fit them. Existing files of these names are refused, with ``mode="overwrite"``
    they alone are replaced.
    """
    check_sizes(n, n)
    fmt = detect_format(path) if fmt == "auto" else fmt
    if fmt not in FORMATS:
        raise ValueError(f"unknown shard format {fmt!r}, use auto or one of {', '.join(FORMATS)}")
    source, target = qualified(spark, path), qualified(spark, out_dir)
    if source == target or mode == "overwrite" and source.startswith(target + "/") or target.startswith(source + "/"):
        raise ValueError(f"{out_dir} and the source {path} overlap")
    stem, suffix = posixpath.splitext(posixpath.basename(path.rstrip("/")))
    if one_file:
        if not suffix or suffix.lower() in PACKED:
            suffix = ENDINGS[fmt]
        names = [f"{stem}.shard{k:04d}{suffix}" for k in range(n)]
        taken = {posixpath.basename(found) for found in holds(spark, out_dir, "*")}.intersection(names)
        if taken and mode != "overwrite":
            raise FileExistsError(f'{out_dir} already holds {min(taken)}: write elsewhere or with mode="overwrite"')
    if fmt == "csv":
        scan = index_csv(spark, path, multi_line)
    else:
        scan = index_text(spark, path) if fmt == "text" else index_parquet(spark, path)
    shards = split_contiguous(scan, n)
    if mode == "overwrite" and not one_file:
        refuse_sources_in(spark, list(scan.files), out_dir)
    if one_file:
        refuse_sources_among(spark, list(scan.files), [f"{target}/{name}" for name in names])
        header = scan.header if fmt == "csv" else None
        if tasks_can_write(target):
            write_named_shards(shards, out_dir, stem, suffix, header, "parquet" if fmt == "parquet" else "text", mode == "overwrite")
        else:
            hidden = f"{out_dir.rstrip('/')}/.rowloom-{uuid.uuid4().hex}"
            _write(shards, scan, fmt, hidden, rows_per_file, True, "errorifexists")
            name_parts(spark, hidden, out_dir, names, mode == "overwrite")
        return shard_plan(spark, scan.total, n, stem, suffix).withColumn("path", output_path(out_dir, F.col("shard_name")))
    _write(shards, scan, fmt, out_dir, rows_per_file, False, mode)
    place = F.concat(F.lit("shard_id="), F.col("shard_id").cast("string"))
    return shard_plan(spark, scan.total, n, stem, suffix).withColumn("path", output_path(out_dir, place))


def _write(shards, scan, fmt, folder, rows_per_file, one_file, mode):
    if fmt == "csv":
        write_csv_records(shards, scan.header, folder, rows_per_file, mode, one_file)
    else:
        write_shards(shards, folder, fmt, rows_per_file, one_file, mode)


def refuse_sources_among(spark: SparkSession, sources: list[str], outputs: list[str]) -> None:
    """Refuse to replace a file that is read."""
    same = {qualified(spark, unquote(source)) for source in sources}.intersection(outputs)
    if same:
        raise ValueError(f"{min(same)} is a source and an output")
