"""Nearest neighbours by a permutation index.

Every vector is represented by the order of its nearest pivots. The table is cut into shards; each
shard posts its vectors in the inverted files of their nearest pivots. A query visits the files of
its own nearest pivots, ranks what it finds there by the footrule distance of the orders, and the
best of each shard are ranked again by exact cosine. All other rows whose angles to the query's
nearest pivots allow a cosine as high as the ``k``-th of these are ranked too, so nothing is missed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import kept

PIVOTS = 256
# Pivots that a vector is posted under, and whose files a query visits.
POSTED = 16
VISITED = 24
# Vectors of a shard and queries of a block; candidates of a shard that are ranked exactly first.
SHARD_ROWS = 8192
BLOCK_ROWS = 4096
CANDIDATES = 320
# What rounding of single precision may take from a bound or an estimate of a cosine, with room.
SLACK = 1e-5


def spread_out(units, count):
    """Up to ``count`` of the vectors: the first, then each time the one farthest from all chosen."""
    if not len(units):
        return units
    chosen, closest = [0], units @ units[0]
    while len(chosen) < min(count, len(units)) and closest.min() < 1 - 1e-12:
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, units @ units[chosen[-1]])
    return units[chosen]


def scaled(vectors):
    """The vectors with each divided by a power of two: exact, and no square overflows or vanishes."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    # two steps, as the power itself may lie beyond the range
    half = exponent // 2
    return np.ldexp(np.ldexp(vectors, -half[:, None]), (half - exponent)[:, None])


def orders(units, pivots):
    """Rank of every pivot for every vector, the pivots by nearness, and the cosines to them."""
    cosine = np.clip(units @ pivots.T, -1, 1)
    by_nearness = np.argsort(-cosine, axis=1, kind="stable")
    rank = np.empty(by_nearness.shape, np.uint8)
    np.put_along_axis(rank, by_nearness, np.arange(by_nearness.shape[1], dtype=np.uint8)[None, :], axis=1)
    return rank, by_nearness, cosine


def cosine_and_sine(cosine):
    return cosine.astype(np.float32), np.sqrt(1 - cosine * cosine).astype(np.float32)


def search_shard(ids, vectors, query_ids, queries, pivots, k):
    """Up to ``k`` nearest rows of a shard for every query: (query id, id, cosine).

    Without ``pivots`` the shard chooses its own.
    """
    by_id = np.argsort(ids, kind="stable")
    ids, vectors, queries = ids[by_id], scaled(vectors[by_id]), scaled(queries)
    norm, query_norm = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (vectors, queries))
    units, query_units = vectors / norm[:, None], queries / query_norm[:, None]
    if pivots is None:
        pivots = spread_out(units[:: max(1, len(units) // (8 * PIVOTS))], PIVOTS)
    rank, near, to_pivot = orders(units, pivots)
    query_rank, query_near, query_to_pivot = orders(query_units, pivots)
    units, query_units = units.astype(np.float32), query_units.astype(np.float32)
    cos, sin = (np.ascontiguousarray(x.T) for x in cosine_and_sine(to_pivot))
    query_cos, query_sin = cosine_and_sine(query_to_pivot)
    # inverted files: the rows of each pivot
    posted = near[:, :POSTED]
    owner = np.repeat(np.arange(len(ids)), posted.shape[1])
    by_pivot = np.argsort(posted.ravel(), kind="stable")
    bounds = np.searchsorted(posted.ravel()[by_pivot], np.arange(len(pivots) + 1))
    files = owner[by_pivot]
    out = []
    for q in range(len(query_ids)):
        found = np.zeros(len(ids), bool)
        for p in query_near[q, :VISITED]:
            found[files[bounds[p] : bounds[p + 1]]] = True
        rows = np.flatnonzero(found)
        if len(rows) < CANDIDATES:
            rows = np.arange(len(ids))
        theirs, mine = rank[rows], query_rank[q]
        footrule = (np.maximum(theirs, mine) - np.minimum(theirs, mine)).sum(axis=1, dtype=np.int32)
        rows = rows[np.argsort(footrule, kind="stable")[: CANDIDATES + 1]]
        rest = ids != query_ids[q]
        rows = rows[rest[rows]]
        rest[rows] = False

        def exact(rows):
            # einsum adds up each row in the same order, so equal vectors tie exactly
            return np.einsum("ij,j->i", vectors[rows], queries[q]) / (norm[rows] * query_norm[q])

        cosine = exact(rows)
        if len(rows) >= k:
            # an angle is no less than the difference of both vectors' angles to any pivot
            least = np.partition(cosine, len(rows) - k)[len(rows) - k] - SLACK
            by = query_near[q, :VISITED]
            bound = (cos[by] * query_cos[q, by, None] + sin[by] * query_sin[q, by, None]).min(axis=0)
            rest = np.flatnonzero(rest & ~(bound < least))
            rest = rest[~(units[rest] @ query_units[q] < least)]
        else:
            rest = np.flatnonzero(rest)
        rows, cosine = np.append(rows, rest), np.append(cosine, exact(rest))
        best = np.lexsort((ids[rows], -cosine))[:k]
        out.append((np.full(len(best), query_ids[q]), ids[rows[best]], cosine[best]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, int), np.empty(0, int), np.empty(0)]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id`` and ``vector`` (doubles) of rows whose vector can be compared."""
    v = F.col(f"`{vector_column}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), v.alias("vector")).where("id is not null and vector is not null")
    good = F.forall("vector", lambda x: x.isNotNull() & (F.abs(F.coalesce(x, F.lit(0.0))) < float("inf")))
    return rows.where(good & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` for every row of ``queries``, by cosine.

    ``query_id``, ``rank`` (from 1, nearest first, ties to the smaller id), ``id_column``,
    ``score``. A query meets all rows with other ids; with fewer than ``k`` of them it gets all.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    without an id. A query meets the vectors of its own length. Up to ``PIVOTS`` vectors that lie far
    from each other, out of ``8 * PIVOTS`` by hash of the id, are pivots of the most common length;
    shards of other lengths choose theirs among their own rows. Query rows of one id are one query,
    by the smallest of their vectors; rows of one id and score are one row of the result.
    """
    base, asked = usable(vectors, id_column, vector_column), usable(queries, id_column, vector_column)
    width = F.size("vector").alias("width")
    asked = asked.groupBy("id").agg(F.min("vector").alias("vector"))

    def parts(df, rows, name):
        return df.groupBy(width).agg(F.count("*").alias("rows")).select("width", "rows", F.ceil(F.col("rows") / rows).cast("int").alias(name))

    # n different lengths take n * n / 2 components, so this table is small whatever the input
    lengths = kept(parts(base, SHARD_ROWS, "shards").join(parts(asked, BLOCK_ROWS, "blocks").drop("rows"), "width"), "lengths")
    common = lengths.orderBy(F.desc("rows"), F.desc("width")).first()
    common = common.width if common else 0
    first = base.where(F.size("vector") == common).orderBy(F.xxhash64("id"), "id").limit(8 * PIVOTS).collect()
    sample = np.array([r.vector for r in first], float).reshape(len(first), common)
    if len(sample):
        sample = scaled(sample)
    pivots = spread_out(sample / np.sqrt((sample**2).sum(1, keepdims=True)), PIVOTS)

    def dealt(df, own, count, other, others):
        every = F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other)
        sized = df.select("id", "vector", width).join(F.broadcast(lengths.drop("rows")), "width")
        return sized.select("id", "vector", "width", F.pmod(F.xxhash64("id"), F.col(count)).cast("int").alias(own), every)

    left = dealt(base, "shard", "shards", "block", "blocks")
    right = dealt(asked, "block", "blocks", "shard", "shards")

    def task(own, wanted):
        if not len(own) or not len(wanted):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64"})
        theirs = pivots if own.width.iloc[0] == common else None
        found = search_shard(own.id.to_numpy(), np.stack(own.vector), wanted.id.to_numpy(), np.stack(wanted.vector), theirs, k)
        return pd.DataFrame(dict(zip(("query_id", "id", "score"), found)))

    found = left.groupBy("width", "shard", "block").cogroup(right.groupBy("width", "shard", "block")).applyInPandas(task, "query_id bigint, id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = found.distinct().withColumn("rank", place).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_column), "score")
