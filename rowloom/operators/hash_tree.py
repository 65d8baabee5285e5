"""A hash tree over the rows of an indexed table, and the row ranges in which two trees differ.

A leaf stands for ``leaf_rows`` consecutive rows.  Its digest is a sum over row digests, so a
task adds up its own rows and only one row per leaf and task is shuffled.  A node above has the
digests of up to ``fanout`` children in order.  Names and types of the columns are part of
every leaf, so columns that differ only in them give another tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.expressions import int_div, row_digest
from rowloom.operators.fingerprint import _summed
from rowloom.operators.row_index import PREFIX, RESERVED, IndexedScan
from rowloom.scratch import checkpointed

LEAF_ROWS = 65_536
FANOUT = 64


def schema_digest(columns: Sequence[tuple[str, str]]) -> str:
    """sha256 (hex) of the names and types of columns, each with its length in bytes in front."""
    parts = [f"{len(part.encode())}:{part}" for column in columns for part in column]
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def hash_tree(scan: IndexedScan, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT, columns: Sequence[str] | None = None) -> DataFrame:
    """level (0: leaves), node, first_row, rows, digest of every node; the last level is the root.

    Equal rows in equal order under equal names and types give equal trees, whatever the files,
    splits and partitions.  A table without rows is one leaf.
    """
    if leaf_rows < 1 or fanout < 2:
        raise ValueError(f"leaf_rows >= 1 and fanout >= 2 needed, got {leaf_rows} and {fanout}")
    chosen = columns or [c for c in scan.df.columns if c not in RESERVED and not c.startswith(PREFIX)]
    fields = [scan.df.schema[c] for c in chosen]
    schema = F.lit(schema_digest([(f.name, f.dataType.simpleString()) for f in fields]))
    spark = scan.df.sparkSession
    if not scan.total:
        empty = F.sha2(F.concat_ws(":", schema, F.lit("0")), 256).alias("digest")
        return spark.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("first_row"), F.lit(0).cast("bigint").alias("rows"), empty)
    row = F.sha2(F.concat_ws(":", F.col("row_idx").cast("string"), row_digest(fields)), 256)
    sums = _summed(scan.df.select(int_div(F.col("row_idx"), leaf_rows).alias("node"), row.alias("_digest")), ["node"])
    level = checkpointed(
        sums.select(
            "node", (F.col("node") * leaf_rows).alias("first_row"), F.col("row_count").alias("rows"),
            F.sha2(F.concat_ws(":", schema, F.col("node").cast("string"), "fingerprint"), 256).alias("digest"),
        )
    )
    levels, nodes = [level], -(-scan.total // leaf_rows)
    while nodes > 1:
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))  # up to ``fanout``
        # every level is kept, so that the plan of one does not hold those of all below it
        level = checkpointed(
            level.groupBy(int_div(F.col("node"), fanout).alias("node")).agg(
                F.min("first_row").alias("first_row"), F.sum("rows").alias("rows"),
                F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), ""), 256).alias("digest"),
            )
        )
        levels, nodes = [*levels, level], -(-nodes // fanout)
    # the level is a literal again: a filter on it reads no other level
    whole, *above = (level.select(F.lit(i).alias("level"), "node", "first_row", "rows", "digest") for i, level in enumerate(levels))
    for level in above:
        whole = whole.unionByName(level)
    return whole


def changed_ranges(old: DataFrame, new: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """first_row, old_rows, new_rows of the leaves that differ between two trees of one shape.

    Goes down from the highest level that both have and looks only at children of nodes that
    differ.  ``old_rows`` or ``new_rows`` is 0 where only one table has rows.  The nodes that differ are
    kept level by level: both sides of the level below need them, so a plan over all levels
    would double with each.
    """
    top = min(tree.agg(F.max("level")).first()[0] for tree in (old, new))

    def differing(level: int, parents: DataFrame | None) -> DataFrame:
        sides = [tree.filter(F.col("level") == level).select("node", "first_row", "rows", "digest") for tree in (old, new)]
        if parents is not None:
            sides = [side.withColumn("parent", int_div(F.col("node"), fanout)).join(parents, "parent", "left_semi").drop("parent") for side in sides]
        left, right = (side.withColumnsRenamed({c: f"{name}_{c}" for c in ("first_row", "rows", "digest")}) for side, name in zip(sides, ("old", "new")))
        return left.join(right, "node", "full").filter(~F.col("old_digest").eqNullSafe(F.col("new_digest")))

    found = differing(top, None)
    for level in range(top - 1, -1, -1):
        found = differing(level, checkpointed(found.select(F.col("node").alias("parent"))))
    rows = [F.coalesce(F.col(f"{name}_rows"), F.lit(0)).cast("bigint").alias(f"{name}_rows") for name in ("old", "new")]
    ranges = found.select(F.coalesce("new_first_row", "old_first_row").alias("first_row"), *rows)
    return ranges.filter("old_rows > 0 or new_rows > 0")
