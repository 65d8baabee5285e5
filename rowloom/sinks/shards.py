"""Writing shards."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.expressions import int_div
from rowloom.operators.row_index import PREFIX, RESERVED, side_bytes
from rowloom.operators.split import Shards
from rowloom.sinks.manifest import record_directories
from rowloom.sinks.named import write_named
from rowloom.scratch import small_side
from rowloom.sinks.replace import refuse_sources_in, replacing, sources_of
from rowloom.sources.csv import LEAD
from rowloom.sources.files import holds
from rowloom.sources.formats import FORMATS

# Minimal quoting, empty text as an empty field, blanks kept.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
MAX_OPEN_FILES = 64
# Bytes of input in a run of rows that one task writes after the shuffle, and how finely runs are cut.
RUN_BYTES = 128 << 20
CELLS_PER_RUN = 64
RUN = PREFIX + "run"  # first row of a run


def write_shards(
    shards: Shards,
    path: str,
    fmt: str = "parquet",
    rows_per_file: int = 1_000_000,
    one_file: bool = False,
    mode: str = "errorifexists",
) -> None:
    """Write every shard to ``path/shard_id=K/``, rows in ``row_idx`` order.

    A shard may be far larger than one task: its files, in the order of their part
    numbers, hold consecutive runs of rows.  Partitions that are already in row order are
    written where they are.  Otherwise one shuffle sends each run of at most
    ``rows_per_file`` rows, and of about ``RUN_BYTES`` of the input where its blocks are
    known, to its own task.

    ``one_file=True`` writes ``path/part-K``, exactly one file per shard; shards are then
    the unit of work, so choose ``n`` to fit them.

    A folder that already holds shards is refused, other files in it stay.
    ``mode="overwrite"`` replaces the whole folder once the new one is whole; a folder with one of
    the files that ``shards`` reads is refused.  A manifest of the finished shards is written last.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown shard format {fmt!r}, use one of {', '.join(FORMATS)}")
    data = [c for c in shards.df.columns if c not in RESERVED and not c.startswith(PREFIX)]
    shards = replace(shards, df=shards.df.select(*data, "shard_id", "row_idx"))
    with placing(shards.df, path, mode) as folder:
        if one_file:
            _save(one_each(shards.df, shards.n).write.mode("append"), fmt, folder)
        elif stays_in_place(shards, rows_per_file):
            _save_by_shard(shards.df, shards.spread, fmt, folder)
        else:
            _save_by_shard(by_chunks(shards, chunk_rows(shards, rows_per_file)).drop(RUN), 0, fmt, folder)
        if not one_file:
            record_directories(shards.df.sparkSession, folder, folder, fmt)


def write_csv_records(
    shards: Shards,
    header: str,
    path: str,
    rows_per_file: int = 1_000_000,
    mode: str = "errorifexists",
    one_file: bool = False,
) -> None:
    """Write the CSV records of ``index_csv`` as they were read, the header first in every file."""
    first_of_shard = F.col("row_idx") == F.col("shard_id") * F.lit(shards.total // shards.n).cast("bigint")
    with_header = F.concat(F.lit(header + "\n"), F.col("value"))
    with placing(shards.df, path, mode) as folder:
        if one_file:
            line = F.when(first_of_shard, with_header).otherwise(F.col("value")).alias("value")
            _save(one_each(shards.df.select(line, "shard_id", "row_idx"), shards.n).write.mode("append"), "text", folder)
            return
        if stays_in_place(shards, rows_per_file):
            placed, first_of_task, spread = shards.df, F.col(LEAD), shards.spread
        else:
            placed = by_chunks(shards, chunk_rows(shards, rows_per_file))
            first_of_task, spread = F.col("row_idx") == F.col(RUN), 0
        line = F.when(first_of_shard | first_of_task, with_header).otherwise(F.col("value"))
        _save_by_shard(placed.select(line.alias("value"), "shard_id", "row_idx"), spread, "text", folder)
        record_directories(shards.df.sparkSession, folder, folder, "csv")


def write_named_shards(shards: Shards, path: str, stem: str, suffix: str, header: str | None = None, fmt: str = "text", replace_files: bool = False) -> None:
    """Write shard k to the file ``path/stem.shardKKKK suffix``, written and named by its task.

    ``fmt``: parquet, or text for lines and CSV records (``header`` goes first in every file).
    Files of the same names are refused, or replaced once all new ones are whole.  The files are in
    the manifest of ``path``.
    """
    df = shards.df
    if header is not None:
        first = F.col("row_idx") == F.col("shard_id") * F.lit(shards.total // shards.n).cast("bigint")
        df = df.withColumn("value", F.when(first, F.concat(F.lit(header + "\n"), F.col("value"))).otherwise(F.col("value")))
    data = ["value"] if fmt == "text" else [c for c in df.columns if c not in RESERVED and not c.startswith(PREFIX)]
    write_named(one_each(df.select(*data, "shard_id", "row_idx"), shards.n), shards.n, path, stem, suffix, fmt, replace_files)


@contextmanager
def placing(df: DataFrame, path: str, mode: str) -> Iterator[str]:
    """The folder to write to: ``path`` itself if it holds no shards yet, else what will replace it."""
    spark = df.sparkSession
    if mode == "errorifexists":
        found = holds(spark, path, "shard_id=*", "part-*")
        if found:
            raise FileExistsError(f'{path} already holds {found[0]}: write elsewhere or with mode="overwrite"')
        yield path
        return
    if mode != "overwrite":
        raise ValueError(f"unknown mode {mode!r}, use errorifexists or overwrite")
    refuse_sources_in(spark, sources_of(df), path)
    with replacing(spark, path) as folder:
        yield folder


def stays_in_place(shards: Shards, rows_per_file: int) -> bool:
    """Write without a shuffle?

    Rows must be in order and no partition may hold very many shards.  An input that cannot
    be cut (one gzip file, one row group) would leave most cores idle: it is spread.
    """
    cores = shards.df.sparkSession.sparkContext.defaultParallelism
    lopsided = shards.widest > rows_per_file and 2 * shards.total < cores * shards.widest
    return shards.in_order and shards.spread <= MAX_OPEN_FILES and not lopsided


def chunk_rows(shards: Shards, rows_per_file: int) -> int:
    """Rows of a task after the shuffle: one file at most, and not too many small shards."""
    return max(1, min(rows_per_file, (shards.total // shards.n) * MAX_OPEN_FILES // 2))


def one_each(df: DataFrame, n: int) -> DataFrame:
    """One partition per shard, rows in order."""
    return df.repartitionById(n, "shard_id").sortWithinPartitions("row_idx").drop("shard_id", "row_idx")


def by_chunks(shards: Shards, rows: int) -> DataFrame:
    """One partition per run of at most ``rows`` rows, in row order, whatever the shards' sizes.

    Where the bytes of the input blocks are known, runs of long rows are shorter.  They are cut
    between cells of equal numbers of rows; the table of cells has some rows per ``RUN_BYTES``.
    """
    size = sum(length for _, length in shards.blocks)
    if size <= RUN_BYTES:
        chunk = int_div(F.col("row_idx"), rows)
        placed = shards.df.withColumn(RUN, chunk * F.lit(rows).cast("bigint"))
        return placed.repartitionById(max(1, -(-shards.total // rows)), chunk.cast("int"))
    width = max(1, min(rows, shards.total * RUN_BYTES // (size * CELLS_PER_RUN)))
    runs = cell_runs(shards, rows, width)
    heads = np.flatnonzero(np.diff(runs, prepend=-1))
    cells = pa.table({PREFIX + "cell": np.arange(len(runs)), PREFIX + "chunk": runs.astype("int32"), RUN: heads[runs] * width})
    table = shards.df.sparkSession.createDataFrame(cells)
    placed = shards.df.withColumn(PREFIX + "cell", int_div(F.col("row_idx"), width)).join(small_side(table, side_bytes(len(runs))), PREFIX + "cell")
    return placed.repartitionById(len(heads), PREFIX + "chunk").drop(PREFIX + "cell", PREFIX + "chunk")


def cell_runs(shards: Shards, rows: int, width: int) -> np.ndarray:
    """The run of every cell of ``width`` rows: as many cells as stay within ``rows`` and ``RUN_BYTES``.

    Within a block all rows count alike; one in which no row begins counts to the block before.
    """
    first, length = (np.array(x) for x in zip(*shards.blocks))
    before = np.cumsum(length) - length
    last = np.append(first[1:] != first[:-1], True)
    edges = np.append(np.arange(0, shards.total, width), shards.total)
    upto = np.interp(edges, np.append(first[last], shards.total), np.append(before[last], length.sum()))
    upto[0] = 0
    runs, run, head = np.zeros(len(edges) - 1, np.int64), 0, 0
    for i in range(1, len(runs)):
        if upto[i + 1] - upto[head] > RUN_BYTES or edges[i + 1] - edges[head] > rows:
            run, head = run + 1, i
        runs[i] = run
    return runs


def _save_by_shard(df: DataFrame, spread: int, fmt: str, path: str) -> None:
    """One directory per shard.

    Partitions in row order touch at most ``spread`` shards: their files are open side by
    side and the rows stream through.  The count must be a true bound, as Spark sorts by
    shard alone beyond it.  With ``spread`` 0 partitions are sorted.
    """
    spark = df.sparkSession
    if not spread:
        df = df.sortWithinPartitions("shard_id", "row_idx")
    before = spark.conf.get(OPEN_FILES)
    spark.conf.set(OPEN_FILES, str(spread + 1 if spread else 0))
    try:
        _save(df.drop("row_idx").write.mode("append").partitionBy("shard_id"), fmt, path)
    finally:
        spark.conf.set(OPEN_FILES, before)


def _save(writer, fmt: str, path: str) -> None:
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.format(fmt).save(path)
