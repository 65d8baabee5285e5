"""A directory of ready-made shards: each file is one shard, used as it is."""

from __future__ import annotations

import logging
import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rowloom.operators.row_index import FILE, side_bytes
from rowloom.operators.split import Shards
from rowloom.scratch import BROADCAST_BYTES, small_side
from rowloom.sources.csv import index_csv, parse_records
from rowloom.sources.files import list_files, qualified
from rowloom.sources.formats import FORMATS, detect_format
from rowloom.sources.parquet import index_parquet
from rowloom.sources.text import index_text

log = logging.getLogger(__name__)

# Bookkeeping files of table writers, never data.
MARKERS = ("_SUCCESS", "_metadata", "_common_metadata")


def scan_shard_dir(spark: SparkSession, directory: str, fmt: str = "auto", expected: int = 0) -> Shards:
    """Rows of every file directly in ``directory``; shard k is the k-th file by path.

    Subdirectories and names with a leading dot are left out.  ``expected`` is checked
    against the number of files unless it is 0.
    """
    base = qualified(spark, directory)
    name = F.col("rel_path")
    listing = list_files(spark, base, recursive=False).filter(~name.startswith(".") & ~name.isin(*MARKERS))
    paths = listing.select("path").toPandas()["path"].tolist()
    unreadable = [path for path in paths if path[len(base) + 1] == "_"]
    if unreadable:
        raise ValueError(f"Spark readers skip names that begin with _, rename {unreadable[:5]}")
    if not paths:
        raise ValueError(f"no shard files in {directory}")
    if expected not in (0, len(paths)):
        raise ValueError(f"{expected} shards expected, but {directory} holds {len(paths)} files")
    fmt = _reader_format(paths, fmt)
    # the files by name: of the folder Spark would read subfolders like k=v too
    named = [re.sub(r"([\\*?\[\]{}])", r"\\\1", path) for path in paths]

    if fmt == "csv":
        records = index_csv(spark, named)
        df, scan = parse_records(records), records
    else:
        scan = index_text(spark, named) if fmt == "text" else index_parquet(spark, named)
        df = scan.df
    shard_of = {path: i for i, path in enumerate(paths)}
    ids = {FILE: list(scan.files), "shard_id": [shard_of[unquote(file)] for file in scan.files]}
    table = spark.createDataFrame(pa.table(ids, pa.schema([(FILE, pa.string()), ("shard_id", pa.int32())])))
    size = side_bytes(len(paths)) + sum(map(len, paths))
    in_order = scan.in_order and size <= BROADCAST_BYTES
    return Shards(df.join(small_side(table, size), FILE), len(paths), scan.total, in_order, scan.widest, blocks=scan.blocks)


def _reader_format(paths, fmt: str) -> str:
    seen = {detect_format(path) for path in paths}
    if fmt == "auto":
        if len(seen) > 1:
            raise ValueError(f"shard files of several formats ({sorted(seen)}): name one")
        return seen.pop()
    if fmt not in FORMATS:
        raise ValueError(f"unknown shard format {fmt!r}, use auto or one of {', '.join(FORMATS)}")
    if seen != {fmt}:
        log.warning("reading shard files as %s, their names say %s", fmt, sorted(seen))
    return fmt
