"""Writing whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rowloom.sinks.replace import replacing
from rowloom.sinks.shards import CSV_OPTIONS
from rowloom.sources.formats import is_parquet


def write_table(df: DataFrame, path: str) -> None:
    """Parquet for ``.parquet`` and ``.pq``, anything else CSV with a header; replaces ``path``.

    The result is a directory of part files, written by all tasks at once beside the old table
    and put in its place when it is whole.  So ``df`` may read the table that it replaces, and a
    write that fails leaves the old one.
    """
    with replacing(df.sparkSession, path) as folder:
        if is_parquet(path):
            df.write.parquet(folder)
        else:
            df.write.options(**CSV_OPTIONS).csv(folder)
