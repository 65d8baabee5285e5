"""Run one program per shard or per file."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import tasks
from rowloom.functions.expressions import int_div
from rowloom.operators.row_index import PID, PREFIX, RESERVED, before
from rowloom.operators.split import Shards
from rowloom.sources.files import list_files, private_copy, qualified
from rowloom.scratch import checkpointed, new_scratch, small_side
from rowloom.sources.directory import MARKERS, scan_shard_dir

# A side file goes to every executor; larger ones are refused.
SIDE_BYTES = 1 << 30
# Bytes of files that share a task, and what opening a file counts for.
TASK_BYTES = 128 << 20
OPEN_COST = 1 << 20

# fn(shard_id, batches) or, with a side file, fn(shard_id, batches, local_path)
ShardProgram = Callable[..., Iterator[pd.DataFrame]]


def map_shards(
    shards: Shards,
    fn: ShardProgram,
    schema: str,
    side: DataFrame | str | None = None,
    whole: bool = True,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Run ``fn`` once per shard; the result is ``shard_id`` plus the columns of ``schema``.

    ``fn`` gets the shard's rows as a stream of pandas batches and yields pandas batches.
    Each shard is one task (one shuffle, rows in ``row_idx`` order), so memory does not
    grow with the shard.  Shards run independently and may be retried: ``fn`` must not
    have side effects of its own.

    ``whole=False`` is for programs whose results can be merged.  ``fn`` then runs on every
    contiguous piece of a shard where the piece was read, without a shuffle and however
    large a shard is, and the caller merges the rows with the same ``shard_id``.

    ``side`` is handed unchanged to every task as a local path: a file as it is, a
    DataFrame as a directory of Parquet files.  ``columns`` names what ``fn`` needs; other
    columns are not read.
    """
    side_name = _ship(shards.df.sparkSession, side) if side is not None else None
    return _run(shards, fn, schema, side_name, whole, columns, record=False)


@dataclass(frozen=True)
class ShardRun:
    """What the shards that succeeded returned, and how every shard ended."""

    rows: DataFrame
    outcome: DataFrame


def record_shards(
    shards: Shards,
    fn: ShardProgram,
    schema: str,
    side: DataFrame | str | None = None,
    run_id: str = "run",
    config: dict[str, str] | None = None,
    columns: Sequence[str] | None = None,
    attempts: int = 1,
) -> ShardRun:
    """Like ``map_shards``, but a shard whose program raises does not stop the others.

    A shard that failed runs again, with no others but those that failed too, until it succeeds or
    has had ``attempts`` runs.  ``outcome`` has one row per attempt: run_id, run_name, shard_id,
    attempt, status, error, rows_out, config; ``rows`` are those of the attempts that succeeded.
    The program finds the number of its attempt in the environment, ``ROWLOOM_ATTEMPT``.  What
    it returns is kept in the shared folder and both frames read it from there.
    """
    side_name = _ship(shards.df.sparkSession, side) if side is not None else None
    return _rounds(lambda again: _run(shards, fn, schema, side_name, True, columns, True, again), schema, shards.n, run_id, config, attempts)


def _rounds(run, schema: str, shards: int, run_id: str, config: dict[str, str] | None, attempts: int) -> ShardRun:
    """Run all shards, then those that failed, up to ``attempts`` times; all rounds together.

    The driver gets one row per failed shard, no more than it had tasks.
    """
    if attempts < 1:
        raise ValueError(f"attempts must be at least 1, got {attempts}")
    rows, outcome, again = None, None, None
    for _ in range(attempts):
        part = _recorded(checkpointed(run(again)), schema, shards, run_id, config)
        rows = part.rows if rows is None else rows.unionByName(part.rows)
        outcome = part.outcome if outcome is None else outcome.unionByName(part.outcome)
        failed = part.outcome.filter("status = 'failed'").select("shard_id", F.col("attempt") + 1) if attempts > 1 else None
        again = sorted(tuple(r) for r in failed.collect()) if failed is not None else []
        if not again:
            break
    return ShardRun(rows, outcome)


def _only(df: DataFrame, again: list[tuple[int, int]]) -> DataFrame:
    """Rows of the shards that run again, with their place among these."""
    table = df.sparkSession.createDataFrame([(shard, i) for i, (shard, _) in enumerate(again)], f"shard_id int, {PREFIX}place int")
    return df.join(small_side(table, 16 * len(again)), "shard_id")


def _recorded(done: DataFrame, schema: str, shards: int, run_id: str, config: dict[str, str] | None) -> ShardRun:
    """Rows and outcomes of a run whose output, with outcome rows among it, is ``done``."""
    names = T.StructType.fromDDL(schema).names
    outcome = done.filter(F.col("_rowloom_status").isNotNull()).select(
        F.lit(run_id).alias("run_id"),
        run_name(run_id, F.col("shard_id"), F.col("_rowloom_attempt")).alias("run_name"),
        "shard_id",
        F.col("_rowloom_attempt").alias("attempt"),
        F.col("_rowloom_status").alias("status"),
        F.col("_rowloom_error").alias("error"),
        F.col("_rowloom_rows_out").alias("rows_out"),
    )
    ids = F.create_map(
        F.lit("run_id"), "run_id", F.lit("shard_id"), F.col("shard_id").cast("string"),
        F.lit("attempt"), F.col("attempt").cast("string"),
    )
    outcome = outcome.withColumn("config", overlay(ids, config or {}))
    good = outcome.filter("status = 'ok'").select("shard_id")
    rows = done.filter(F.col("_rowloom_status").isNull()).select("shard_id", *names)
    return ShardRun(rows.join(small_side(good, 16 * shards), "shard_id", "left_semi"), outcome)


def run_name(run_id: str, shard_id: Column, attempt: Column) -> Column:
    """A name that a retried attempt does not share with the first one."""
    return F.format_string("%s-shard-%d-a-%d", F.lit(run_id), shard_id, attempt)


def overlay(ids: Column, config: dict[str, str]) -> Column:
    """``ids`` with ``config`` on top: on equal keys the caller's value stays."""
    if not config:
        return ids
    own = F.create_map(*[F.lit(x) for pair in config.items() for x in pair])
    return F.map_concat(F.map_filter(ids, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)


def map_files(
    spark: SparkSession,
    directory: str,
    fn: ShardProgram,
    schema: str,
    fmt: str,
    expected: int = 0,
    side: DataFrame | str | None = None,
    whole: bool = True,
    columns: Sequence[str] | None = None,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """``map_shards`` over a directory of ready-made files, one shard per file.

    ``fmt="raw"`` hands each file over as it is, whatever it holds: ``fn(shard_id, stream)``, or
    with a side file ``fn(shard_id, stream, local_path)``, gets a binary file that is opened in
    the task (``stream.path`` is its path, a seek is allowed) and yields pandas or Arrow batches.
    Nothing is read beforehand and no format, header or encoding is assumed.  Neighbouring small
    files share a task up to ``task_bytes``; memory does not grow with a file unless ``fn`` makes it.
    """
    if fmt == "raw":
        if columns or not whole:
            raise ValueError("raw files have no columns and are not cut in pieces")
        return _run_files(spark, directory, fn, schema, expected, side, task_bytes, record=False)[0](None)
    return map_shards(scan_shard_dir(spark, directory, fmt, expected), fn, schema, side, whole, columns)


def record_files(
    spark: SparkSession,
    directory: str,
    fn: ShardProgram,
    schema: str,
    expected: int = 0,
    side: DataFrame | str | None = None,
    run_id: str = "run",
    config: dict[str, str] | None = None,
    task_bytes: int = TASK_BYTES,
    attempts: int = 1,
) -> ShardRun:
    """``record_shards`` over the files of a directory as they are (``map_files`` with ``fmt="raw"``)."""
    run, count = _run_files(spark, directory, fn, schema, expected, side, task_bytes, record=True)
    return _rounds(run, schema, count, run_id, config, attempts)


def packed_files(spark: SparkSession, directory: str, expected: int = 0, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, int, int]:
    """The shard files of a directory with ``shard_id`` (place by path) and ``bin``; numbers of files and bins.

    Files follow each other in bins of about ``task_bytes``, each file counted with what opening it
    costs, or smaller ones where that leaves cores idle; a file is never cut, a larger one has a bin
    to itself.  Prefix sums go by partitions of the sorted listing: the driver gets a row for each.
    """
    base = qualified(spark, directory)
    name = F.col("rel_path")
    listing = list_files(spark, base, recursive=False).filter(~name.startswith(".") & ~name.isin(*MARKERS))
    cost = F.col("length") + F.lit(OPEN_COST)
    ordered = checkpointed(listing.select("path", "rel_path", "length")).withColumn(PID, F.spark_partition_id())
    parts = ordered.groupBy(PID).agg(F.count("*").alias("rows"), F.sum(cost).alias("cost")).toPandas().sort_values(PID, ignore_index=True)
    count = int(parts["rows"].sum())
    if not count:
        raise ValueError(f"no shard files in {directory}")
    if expected not in (0, count):
        raise ValueError(f"{expected} shards expected, but {directory} holds {count} files")
    total = int(parts["cost"].sum())
    size = max(1, min(task_bytes, -(-total // (4 * spark.sparkContext.defaultParallelism))))
    parts = parts.assign(rows=before(parts["rows"]), cost=before(parts["cost"]))
    starts = spark.createDataFrame(parts.astype("int64"), f"{PID} int, rows bigint, cost bigint")
    upto = Window.partitionBy(PID).orderBy("path")
    placed = ordered.join(F.broadcast(starts), PID).select(
        "path", "rel_path", "length", PID,
        (F.col("rows") + F.row_number().over(upto) - 1).cast("int").alias("shard_id"),
        int_div(F.col("cost") + F.sum(cost).over(upto) - cost, size).alias("bin"),
    )
    # number the bins that have files, in order: partitions may share a bin at their ends
    bins = placed.groupBy(PID).agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.countDistinct("bin").alias("bins"))
    bins = bins.toPandas().sort_values(PID, ignore_index=True)
    shared = (bins["first"] == bins["last"].shift(1)).cumsum()
    lead = spark.createDataFrame(bins.assign(lead=before(bins["bins"]) - shared)[[PID, "lead"]].astype("int64"), f"{PID} int, lead bigint")
    number = (F.col("lead") + F.dense_rank().over(Window.partitionBy(PID).orderBy("bin")) - 1).cast("int").alias("bin")
    dense = placed.join(F.broadcast(lead), PID).select("path", "rel_path", "length", "shard_id", number)
    return dense, count, int(bins["bins"].sum() - shared.iloc[-1])


def _run_files(spark, directory, fn, schema, expected, side, task_bytes, record) -> tuple[Callable, int]:
    """A function that runs ``fn`` on the files, all (None) or those that run again; their number."""
    placed, count, bins = packed_files(spark, directory, expected, task_bytes)
    side_name = _ship(spark, side) if side is not None else None
    names = T.StructType.fromDDL(schema).names

    def run(again):
        chosen = placed.repartitionById(bins, "bin") if again is None else _only(placed, again).repartitionById(len(again), f"{PREFIX}place")
        dealt = chosen.sortWithinPartitions("shard_id").select("shard_id", "path")
        return dealt.mapInPandas(tasks.file_worker(fn, names, side_name, record, again), _output(schema, record))

    return run, count


OUTCOME = "_rowloom_attempt int, _rowloom_status string, _rowloom_error string, _rowloom_rows_out bigint"


def _run(shards: Shards, fn, schema: str, side_name: str | None, whole: bool, columns, record: bool, again=None) -> DataFrame:
    names = T.StructType.fromDDL(schema).names
    data = columns or [c for c in shards.df.columns if c not in RESERVED and not c.startswith(PREFIX)]
    df = shards.df.select(*data, "shard_id", "row_idx")
    if again:
        df = _only(df, again).repartitionById(len(again), f"{PREFIX}place").drop(f"{PREFIX}place").sortWithinPartitions("row_idx")
    elif whole:
        df = df.repartitionById(shards.n, "shard_id").sortWithinPartitions("shard_id", "row_idx")
    df = df.drop("row_idx").select("shard_id", *data) if again else df.drop("row_idx")
    return df.mapInPandas(tasks.shard_worker(fn, names, side_name, whole, record, again), _output(schema, record))


def _output(schema: str, record: bool) -> T.StructType:
    """What the task code returns: shard_id, the columns of ``schema`` and those of the outcome."""
    fields = [T.StructField("shard_id", T.IntegerType())] + T.StructType.fromDDL(schema).fields
    return T.StructType(fields + (T.StructType.fromDDL(OUTCOME).fields if record else []))


def _ship(spark: SparkSession, side: DataFrame | str) -> str:
    """Register a side file with the session; executors fetch it once each.

    Every call ships a copy under a name of its own: a session takes each name once.  Spark ships
    no local folders between machines: tasks open those, by the path returned, in the shared
    folder, which every machine has mounted then.
    """
    path = side
    if isinstance(side, DataFrame):
        path = new_scratch(spark, "side")
        side.write.parquet(path)
    path, recursive = private_copy(spark, path, new_scratch(spark, "shipped"), SIDE_BYTES)
    place = qualified(spark, path)
    if recursive and place.startswith("file:"):
        return "/" + place.removeprefix("file:").lstrip("/")
    spark.sparkContext.addFile(path, recursive=recursive)
    return posixpath.basename(path)
