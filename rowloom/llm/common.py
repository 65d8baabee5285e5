"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.scratch import new_scratch


def remainder(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def kept(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: computed once, lineage cut.

    ``files``: at most so many part files, for tables that are small beside the input; executors
    start processes for the permissions of every file.
    """
    path = new_scratch(df.sparkSession, label)
    (df.coalesce(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the actions inside go as soon as each has ended; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def prepared(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast; whatever else ``df`` has stays out of the way."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


def carried(carry, *made: str) -> tuple[str, ...]:
    """The columns to carry along; one with the name of a result column ``made`` gives way to that."""
    own = {name.lower() for name in made}
    return tuple(c for c in carry if c.lower() not in own)


def tasks_at_once(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def arrow(df: DataFrame, task, schema: str | T.StructType) -> DataFrame:
    return df.mapInArrow(task, schema)


def hash_share(key: Column, share: Column | float) -> Column:
    """True for about ``share`` of the keys, always the same ones."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < F.lit(share) * (1 << 30)


def usable_labels(labels: DataFrame, id_column: str, label_column: str) -> DataFrame:
    return prepared(labels, **{id_column: "bigint", label_column: "int"}).where(f"{id_column} is not null and {label_column} in (0, 1)")


def sample_shares(labels: DataFrame, id_column: str, label_column: str, rows: int) -> dict[int, float]:
    """Of each label, the share of the rows that makes about ``rows``."""
    counts = {r[label_column]: r["count"] for r in usable_labels(labels, id_column, label_column).groupBy(label_column).count().collect()}
    return {label: rows / max(counts.get(label, 0), rows) for label in (0, 1)}


def labelled_sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, rows: int, shares: dict[int, float] | None = None) -> DataFrame:
    """``text`` and ``label`` of about ``rows`` labelled documents of each label, chosen by hash of the id.

    Every label row that has an id and a label 0 or 1 can be chosen; what is sent to all tasks is
    bounded by ``rows``. ``shares`` are those of ``sample_shares``, if the caller needs them too.
    """
    shares = shares or sample_shares(labels, id_column, label_column, rows)
    share = F.when(F.col(label_column) == 1, shares[1]).otherwise(shares[0])
    chosen = usable_labels(labels, id_column, label_column).where(hash_share(F.col(id_column), share)).select(F.col(id_column).alias("__id"), F.col(label_column).alias("label"))
    texts = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("__id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "__id").select("text", "label")
