"""Contiguous, row-balanced shards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.expressions import shard_of
from rowloom.operators.row_index import IndexedScan


@dataclass(frozen=True)
class Shards:
    """A DataFrame with ``shard_id`` (0 .. n-1) and ``row_idx``.

    ``in_order``, ``widest`` and ``blocks`` as in ``IndexedScan``; ``spread`` bounds the number of
    shards within a partition (0: not known).
    """

    df: DataFrame
    n: int
    total: int
    in_order: bool
    widest: int = 0
    spread: int = 0
    blocks: tuple[tuple[int, int], ...] = ()


def split_contiguous(scan: IndexedScan, n: int) -> Shards:
    """Shard k holds the k-th block of rows.  Plain arithmetic on ``row_idx``, no shuffle."""
    df = scan.df.withColumn("shard_id", shard_of(F.col("row_idx"), scan.total, n))
    spread = scan.widest // (scan.total // n) + 2 if scan.widest else 0
    return Shards(df, n, scan.total, scan.in_order, scan.widest, spread, scan.blocks)
