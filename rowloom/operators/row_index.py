"""Global row index without a one-task window.

A scan's rows sit in input blocks (splits).  One narrow job counts the rows of each
block; a running sum over that small table, one row per input split, gives every block
its first row number.  The second scan adds the position inside the block.  Rows are
never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.scratch import BROADCAST_BYTES, checkpointed, small_side

# Helper columns; writers and programs never see names with this prefix.
PREFIX = "_rowloom_"
FILE, START, LENGTH = PREFIX + "file", PREFIX + "start", PREFIX + "length"  # where a row was read
M = PREFIX + "m"  # rises along the rows of a partition
SEEN, FIRST, LAST = PREFIX + "seen", PREFIX + "first", PREFIX + "last"  # what the count saw
PID, BASE = PREFIX + "pid", PREFIX + "base"
RESERVED = ("row_idx", "shard_id")


@dataclass(frozen=True)
class IndexedScan:
    """A DataFrame with a gap-free ``row_idx`` (0-based) and its row count.

    ``in_order`` says that rows lie in ``row_idx`` order within and across partitions, so
    that writers can keep the order without a shuffle.  ``widest`` bounds the rows of a
    partition (0: not known).  ``blocks`` has the first row and the bytes of every input block,
    in row order (empty: not known).
    """

    df: DataFrame
    total: int
    in_order: bool
    widest: int = 0
    files: tuple[str, ...] = ()  # as ``FILE`` spells them, in row order
    blocks: tuple[tuple[int, int], ...] = ()


def position_columns() -> list[Column]:
    """Must be selected directly from a file reader."""
    return [
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(START),
        F.col("_metadata.file_block_length").alias(LENGTH),
        F.monotonically_increasing_id().alias(M),
    ]


def refuse_reserved(df: DataFrame) -> None:
    taken = [c for c in df.columns if c.lower() in RESERVED or c.startswith(PREFIX)]
    if taken:
        raise ValueError(f"rename the columns {taken}: these names are used for the split")


def count_blocks(placed: DataFrame, *more: Column) -> pd.DataFrame:
    """One row per input block in (file, start) order: row count, lowest ``_m``.

    Files go by plain path; ``_metadata`` spells them URL-encoded.
    """
    counted = placed.groupBy(FILE, START, LENGTH).agg(
        F.count("*").alias("rows"), F.min(M).alias("min_m"), *more
    )
    blocks = counted.toPandas()
    order = pd.DataFrame({"file": blocks[FILE].map(unquote), "start": blocks[START]})
    return blocks.iloc[order.sort_values(["file", "start"]).index].reset_index(drop=True)


def files_of(blocks: pd.DataFrame) -> tuple[str, ...]:
    return tuple(blocks[FILE].unique())


def block_sizes(blocks: pd.DataFrame, first_rows: pd.Series) -> tuple[tuple[int, int], ...]:
    return tuple(zip(first_rows.astype("int64").tolist(), blocks[LENGTH].astype("int64").tolist()))


def widest(blocks: pd.DataFrame) -> int:
    """Rows of the largest partition; the upper bits of ``min_m`` number the partitions."""
    return int(blocks["rows"].groupby(blocks["min_m"] // 2**33).sum().max())


def side_bytes(rows: int, names: pd.Series | None = None) -> int:
    """Bytes of a table of at most 20 numbers, and a name, per row."""
    return 160 * rows + (0 if names is None else int(names.str.len().sum()))


def broadcasts(blocks: pd.DataFrame) -> bool:
    return side_bytes(len(blocks), blocks[FILE]) <= BROADCAST_BYTES


def before(sizes: pd.Series) -> pd.Series:
    """Sum of all earlier sizes."""
    return sizes.cumsum() - sizes


def rises(values: pd.Series) -> bool:
    return bool(values.is_monotonic_increasing)


def attach_blocks(placed: DataFrame, blocks: pd.DataFrame, columns: Sequence[str]) -> DataFrame:
    """Join ``columns`` of the block table to the rows and check that the splits agree.

    The table has one row per input split.  The join is a broadcast up to
    ``BROADCAST_BYTES``, a sort-merge join beyond.  A block that now has another
    length, or other rows before it in its partition, has rows outside its range of ``M``.
    Every column is behind the check, so that a filter on it cannot turn the left join into
    one that drops rows.
    """
    spark = placed.sparkSession
    keys = [START] if blocks[FILE].nunique() == 1 else [FILE, START]
    side = blocks[[*keys, *columns]].assign(
        **{SEEN: blocks[LENGTH], FIRST: blocks["min_m"], LAST: blocks["min_m"] + blocks["rows"] - 1}
    )
    table = spark.createDataFrame(pa.Table.from_pandas(side, preserve_index=False))
    joined = placed.join(small_side(table, side_bytes(len(blocks), blocks[FILE])), keys, "left")
    same = (F.col(LENGTH) == F.col(SEEN)) & F.col(M).between(F.col(FIRST), F.col(LAST))
    changed = F.raise_error(F.lit("input splits changed between counting and reading"))
    kinds = dict(table.dtypes)
    checked = {c: F.when(same, F.col(c)).otherwise(changed.cast(kinds[c])) for c in columns}
    return joined.withColumns(checked).drop(SEEN, FIRST, LAST)


def index_blocks(placed: DataFrame, blocks: pd.DataFrame) -> IndexedScan:
    """``row_idx`` for a scan whose lines or rows are the records."""
    if blocks.empty:
        return IndexedScan(placed.withColumn("row_idx", F.col(M)), 0, True)
    first_rows = before(blocks["rows"])
    blocks = blocks.assign(**{BASE: first_rows - blocks["min_m"]})
    df = attach_blocks(placed, blocks, [BASE]).withColumn("row_idx", F.col(BASE) + F.col(M)).drop(BASE)
    in_order = rises(blocks["min_m"]) and broadcasts(blocks)
    return IndexedScan(df, int(blocks["rows"].sum()), in_order, widest(blocks), files_of(blocks), block_sizes(blocks, first_rows))


def with_row_index(df: DataFrame, order_by: Sequence[str]) -> IndexedScan:
    """Row index along a unique key, for tables that have no file order.

    The key is checked first: repeated keys would all land in one range, and their order
    would be chance.  One range shuffle; the sorted table is written once to the shared
    folder, because a second run could draw other range bounds.  Offsets are per partition.
    """
    refuse_reserved(df)
    missing = [c for c in order_by if c not in df.columns]
    if missing or not order_by:
        raise ValueError(f"order_by needs columns of the table, got {list(order_by)}")
    repeated = df.groupBy(*order_by).count().filter("count > 1").first()
    if repeated is not None:
        raise ValueError(f"order_by is not unique, for example {repeated.asDict()}: add columns")
    spark = df.sparkSession
    placed = checkpointed(df.orderBy(*order_by)).select(
        "*", F.spark_partition_id().alias(PID), F.monotonically_increasing_id().alias(M)
    )
    counts = placed.groupBy(PID).agg(F.count("*").alias("rows"), F.min(M).alias("min_m"))
    parts = counts.toPandas().sort_values(PID, ignore_index=True)
    if parts.empty:
        return IndexedScan(placed.withColumn("row_idx", F.col(M)).drop(PID, M), 0, True)
    parts[BASE] = before(parts["rows"]) - parts["min_m"]
    side = spark.createDataFrame(pa.Table.from_pandas(parts[[PID, BASE]], preserve_index=False))
    indexed = placed.join(small_side(side, side_bytes(len(parts))), PID).withColumn("row_idx", F.col(BASE) + F.col(M))
    in_order = side_bytes(len(parts)) <= BROADCAST_BYTES
    return IndexedScan(indexed.drop(PID, M, BASE), int(parts["rows"].sum()), in_order, int(parts["rows"].max()))
