"""Mixing sources to target weights by weighted fair queueing.

Every source has its documents in shuffled order, up to three times over. A document's virtual
finish time is the number of words of its source up to and including it, divided by the source's
target. All documents are taken in order of finish time until the total budget is reached, which is
when every source has come to about its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import kept

# Times that a document may be taken; its source's target is at most as many times its size.
REPEATS = 3
# Copies of one row that are numbered by one task at once.
COPIES = 4096
# Documents that share one window; cells of virtual time in each of two rounds.
WINDOW_ROWS = 20_000
CELLS = 4096
# The targets are computed on the driver.
MOST_SOURCES = 100_000


def cycled_weights(sources: list) -> list[int]:
    """1, 2, 3, 1, 2, 3 ... for sources in order."""
    return [1 + i % 3 for i in range(len(sources))]


def targets(sizes: list[int], weights: list[int], most: int = REPEATS) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, none above ``most`` times its own size.

    What a source cannot take goes to the others by weight, until none is above its limit.
    """
    total, free = sum(sizes), sum(weights)
    out: dict[int, float] = {}
    by_limit = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    for at, i in enumerate(by_limit):
        if weights[i] * total > most * sizes[i] * free:
            out[i] = float(most * sizes[i])
            total, free = total - most * sizes[i], free - weights[i]
        else:
            out |= {j: weights[j] * total / free for j in by_limit[at:]}
            break
    return [out[i] for i in range(len(sizes))]


def shuffle_key(text):
    """60 bits by which documents are shuffled."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def spread(rows: DataFrame, bits: int) -> DataFrame:
    """``rows`` (id, source, size, print, key) without ``print``, with new keys where one id has too many rows.

    Such ids are looked for only in buckets that are far too full; they are fewer than the rows by
    ``WINDOW_ROWS``. Their copies are counted, then numbered by ranges that are dealt to all tasks.
    """
    if not bits:
        return rows.drop("print")
    bucket = F.shiftright("key", 60 - bits).alias("bucket")
    full = rows.groupBy(bucket).count().where(F.col("count") > 4 * WINDOW_ROWS).select("bucket")
    many = rows.select("id", bucket).join(F.broadcast(full), "bucket", "left_semi").groupBy("id").count().where(F.col("count") > WINDOW_ROWS)
    many = kept(many.select(F.col("id").alias("often")), "often")

    def of(how):
        return rows.join(F.broadcast(many), F.col("id").eqNullSafe(F.col("often")), how)

    alike = of("left_semi").groupBy("id", "source", "size", "print").agg(F.count("*").alias("copies"))
    ranges = alike.withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES).cast("bigint"))))
    copy = F.explode(F.sequence("from", F.least("copies", F.col("from") + COPIES) - 1)).alias("copy")
    dealt = ranges.repartition("id", "print", "from").select("id", "source", "size", "print", copy)
    key = shuffle_key(F.concat_ws(":", F.col("id").cast("string"), F.col("print").cast("string"), F.col("copy").cast("string")))
    return of("left_anti").drop("print").unionByName(dealt.select("id", "source", "size", key.alias("key")))


def fair_queue_mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights=cycled_weights) -> DataFrame:
    """``id_column``, source, ``size``, ``source_size``, ``target``, ``taken`` of every row of ``docs``.

    ``size`` is the number of words of the text (null: 0), ``source_size`` and ``target`` are those
    of the row's source (null is a source of its own, the last one), ``taken`` is the number of
    words that the mix takes from the row: 0 to 3 times its size. ``weights`` gives whole weights
    above 0 for the list of sources in code point order. The shuffle follows the id, so reruns
    agree; rows with equal ids follow each other by size. Only where more than ``WINDOW_ROWS`` rows
    have one id, or none, it follows the text and the number of the copy too, so that they are
    spread like all others. Without any word all is 0. Other columns are left out.
    """
    text = F.col(f"`{text_column}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_column}`").cast("bigint").alias("id"),
        F.col(f"`{source_column}`").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(text).alias("print"),
    )
    rows = kept(rows.withColumn("key", shuffle_key(F.coalesce(F.col("id").cast("string"), F.lit("")))), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [r["size"] for r in totals]
    wanted = targets(sizes, weights([r.source for r in totals]))
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(r.source, i, s, t) for i, (r, s, t) in enumerate(zip(totals, sizes, wanted))], "name string, no int, source_size bigint, target double"
    )
    bits = max(0, (sum(r.rows for r in totals) // WINDOW_ROWS).bit_length())
    numbered = spread(rows, bits).join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    numbered = numbered.withColumn("bucket", F.shiftright("key", 60 - bits) if bits else F.lit(0).cast("bigint"))
    order = ["key", F.coalesce("id", F.lit(0)), "size"]
    # words before each bucket of a source, then before each document of a bucket
    before = Window.partitionBy("no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = numbered.groupBy("no", "bucket").agg(F.sum("size").alias("words"))
    offsets = buckets.select("no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("no", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = numbered.withColumn("up_to", F.sum("size").over(inside)).join(offsets, ["no", "bucket"])
    placed = kept(placed.withColumn("up_to", F.col("up_to") + F.col("offset")).drop("bucket", "offset"), "placed")

    def finish(turn):
        return (F.col("source_size") * turn + F.col("up_to")).cast("double") / F.col("target")

    def rank(turn):
        return F.struct(finish(turn).alias("finish"), F.col("no").alias("no"), F.lit(turn).alias("turn"), F.col("key").alias("key"), F.coalesce("id", F.lit(0)).alias("id"))

    turns = placed.where("size > 0").select("size", F.explode(F.array(*[rank(t) for t in range(REPEATS)])).alias("at"))
    last = cut(turns, sum(sizes))
    times = F.lit(0)
    if last is not None:
        end = F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(last, (("finish", "double"), ("no", "int"), ("turn", "int"), ("key", "bigint"), ("id", "bigint")))])
        for t in range(REPEATS):
            times += F.when((F.col("size") > 0) & (rank(t) <= end), 1).otherwise(0)
    return placed.select(F.col("id").alias(id_column), F.col("source").alias(source_column), "size", "source_size", "target", (F.col("size") * times).cast("bigint").alias("taken"))


def cut(turns: DataFrame, budget: int):
    """The last place at which all taken up to it stay within the budget.

    Two rounds of sums by cell of virtual time lead to one cell, whose few documents are added up
    one by one.
    """
    if not budget:
        return None
    time = F.least(F.col("at.finish"), F.lit(4.0))
    cell = F.floor(time * CELLS)
    spent = 0
    for fine in (cell, F.floor((time * CELLS - cell) * CELLS)):
        sums = sorted(turns.groupBy(fine.alias("cell")).agg(F.sum("size").alias("words")).collect())
        for at, words in sums:
            if spent + words > budget:
                break
            spent += words
        turns = turns.where(fine == at)
    total = F.sum("size").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    found = turns.withColumn("total", total + spent).where(F.col("total") <= budget).agg(F.max("at")).first()[0]
    if found is not None:
        return found
    # the first document of the cell is already too much: all before the cell are taken
    first = turns.agg(F.min("at")).first()[0]
    return (first[0], first[1], first[2], first[3], first[4] - 1)
