"""Shared scratch space and the size rule for broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its counted bytes stay below this.  The sides here are
# metadata (one row per input split, per file or per shard): two million splits at least.
BROADCAST_BYTES = 512 << 20


def small_side(df: DataFrame, size: int) -> DataFrame:
    """Broadcast ``df`` when its known size in bytes is small, else ask for a sort-merge join."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("merge")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A local temporary folder is chosen only when the session names none and runs in
    local mode.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="rowloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_scratch(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_dir(spark)}/rowloom-{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, in the shared folder, and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
