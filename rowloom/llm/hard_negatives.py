"""Hard negatives by the threshold algorithm over integer inner products.

The table is cut into shards. A shard keeps, for every dimension, its rows in the order of that
component. An anchor reads each dimension's list from the end that its own sign favours (sorted
access), scores every row that it meets there in full (random access), and knows from the last
components read how high a row not met yet can score. It stops once that threshold lies strictly
below the last score wanted of every window. What the shards find is merged by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.arrays import get_array, put_array
from rowloom.llm.common import kept
from rowloom.scratch import new_scratch

# Components held by a shard and by a file of anchors; both have one row at least.
SHARD_VALUES = 1 << 19
BLOCK_VALUES = 1 << 18
# Places of each list that the first round reads; every round reads as many as all before it.
FIRST_READ = 8


def quantised(vectors, scale):
    """floor(scale * x) of every component, in numbers in which all inner products are exact.

    Doubles while every sum stays below 2**53, then longs, then Python integers.
    """
    whole = np.floor(scale * np.asarray(vectors, np.float64))
    bound = float(np.abs(whole).max(initial=0)) ** 2 * max(1, whole.shape[1])
    if bound < 2.0**53:
        return whole
    return whole.astype(np.int64) if bound < 2.0**62 else np.vectorize(int, otypes=[object])(whole)


def together(left, right):
    """Both arrays in the numbers of the one that needs the wider ones."""
    bound = max(float(abs(x).max()) if x.size else 0.0 for x in (left, right)) ** 2 * max(1, left.shape[-1])
    kind = np.float64 if bound < 2.0**53 else np.int64 if bound < 2.0**62 else object
    return tuple(x if x.dtype == kind else np.vectorize(int, otypes=[object])(x) if kind is object else x.astype(kind) for x in (left, right))


class Lists:
    """Rows of a shard, and for every dimension their order by that component."""

    def __init__(self, ids, labels, values):
        self.ids, self.labels, self.values = ids, labels, values
        by_size = np.argsort(values.astype(np.float64), axis=0, kind="stable").T.astype(np.int32)
        # of every dimension its order from the lowest and from the highest component
        self.order = np.stack([by_size, by_size[:, ::-1]])

    def rounds(self, anchor):
        """After every round the rows met in it, their scores, and the most that other rows can score."""
        n, width = self.values.shape
        used = np.flatnonzero(anchor != 0)
        if not n:
            return
        if not len(used):  # every score is zero and no list says anything
            yield np.arange(n), np.zeros(n, self.values.dtype), None
            return
        end = np.asarray(anchor[used] > 0).astype(np.int64)
        met = np.zeros(n, bool)
        read, upto = 0, min(FIRST_READ, n)
        while read < n:
            rows = self.order[end, used, read:upto]
            fresh = ~met
            met[rows.ravel()] = True
            fresh &= met
            new = np.flatnonzero(fresh)
            last = rows[:, -1]
            threshold = (anchor[used] * self.values[last, used]).sum()
            yield new, self.values[new] @ anchor, threshold
            if met.all():
                return
            read, upto = upto, min(2 * upto, n)


def best(scores, ids, k):
    """Places of the ``k`` highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def positives_of(lists, anchor, own_id, k):
    """The first ``k`` rows of ``lists`` but the anchor's own: ids and scores."""
    rows, scores = np.empty(0, np.int64), np.empty(0, lists.values.dtype)
    for new, found, threshold in lists.rounds(anchor):
        other = lists.ids[new] != own_id
        rows, scores = np.append(rows, new[other]), np.append(scores, found[other])
        if len(rows) > k:
            keep = best(scores, lists.ids[rows], k)
            rows, scores = rows[keep], scores[keep]
        if len(rows) == k and threshold is not None and scores.min() > threshold:
            break
    keep = best(scores, lists.ids[rows], k)
    return lists.ids[rows[keep]], scores[keep]


def negatives_of(lists, anchor, own_label, windows, k):
    """For every window (low, high) of scores the first ``k`` rows of other labels in it: ids and scores."""
    held = [(np.empty(0, np.int64), np.empty(0, lists.values.dtype))] * len(windows)
    open_ones = [i for i, (low, high) in enumerate(windows) if low <= high]
    for new, found, threshold in lists.rounds(anchor) if open_ones else ():
        other = lists.labels[new] != own_label
        new, found = new[other], found[other]
        still = []
        for i in open_ones:
            low, high = windows[i]
            fits = (found >= low) & (found <= high)
            rows, scores = np.append(held[i][0], new[fits]), np.append(held[i][1], found[fits])
            if len(rows) > k:
                keep = best(scores, lists.ids[rows], k)
                rows, scores = rows[keep], scores[keep]
            held[i] = rows, scores
            full = len(rows) == k and threshold is not None and scores.min() > threshold
            if not full and not (threshold is not None and threshold < low):
                still.append(i)
        open_ones = still
        if not open_ones:
            break
    out = []
    for rows, scores in held:
        keep = best(scores, lists.ids[rows], k)
        out.append((lists.ids[rows[keep]], scores[keep]))
    return out


def window_of(score, low, high, unit):
    """Whole scores s with low * score <= unit * s <= high * score."""
    score = int(score)
    return -((-low * score) // unit), high * score // unit


def longs(values):
    """Scores as longs; one that does not fit raises."""
    return pa.array([int(v) for v in values], pa.int64())


def usable(rows: DataFrame, id_column: str, label_column: str, vector_column: str) -> DataFrame:
    """``id``, ``label``, ``vector`` of the rows that take part, one for each id."""
    chosen = rows.select(
        F.col(f"`{id_column}`").cast("bigint").alias("id"),
        F.col(f"`{label_column}`").cast("bigint").alias("label"),
        F.col(f"`{vector_column}`").cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(F.coalesce(x, F.lit(0.0))) < float("inf")))
    good = chosen.where("id is not null and label is not null and vector is not null").where(finite)
    first = good.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return first.select("id", "row.label", "row.vector")


def unpacked(table, width):
    """Ids, labels and vectors of a table, in the order of the ids."""
    ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
    vectors = pc.list_flatten(table.column("vector")).to_numpy().reshape(len(ids), width)
    order = np.argsort(ids)
    return ids[order], labels[order], vectors[order]


def sharded(rows: DataFrame, values: int, name: str) -> DataFrame:
    """Rows in parts, numbered ``name`` by hash of the id, of about ``values`` components each.

    A part is a partition of its own as far as the hash of its number allows.
    """
    widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("rows"))
    share = F.greatest(F.ceil(F.col("rows") * F.greatest("width", F.lit(1)) / F.lit(values)), F.lit(1))
    plan = widths.select("width", share.cast("bigint").alias("shares"))
    placed = rows.withColumn("width", F.size("vector")).join(plan, "width")
    placed = placed.withColumn(name, F.pmod(F.xxhash64("id"), F.col("shares"))).drop("shares")
    return placed.repartition(max(1, 2 * (plan.agg(F.sum("shares")).first()[0] or 0)), "width", name)


def anchor_files(anchors: DataFrame, path: str) -> list[tuple[int, str]]:
    """Write the anchors in files of about BLOCK_VALUES components; (width, file) of each.

    A file has a row per anchor: id, label, the scores of its positives (their number first), vector.
    """

    def write(key, table):
        width, block = (k.as_py() for k in key)
        ids, labels, vectors = unpacked(table, width)
        lists = dict(zip(table.column("id").to_pylist(), table.column("scores").to_pylist()))
        most = max((len(lists[i]) for i in ids.tolist()), default=0)
        wide = np.zeros((len(ids), 3 + most), np.int64)
        wide[:, 0], wide[:, 1] = ids, labels
        for row, i in zip(wide, ids.tolist()):
            row[2], row[3 : 3 + len(lists[i])] = len(lists[i]), lists[i]
        name = f"{path}/{width}-{block}"
        put_array(f"{name}-keys.npy", wide)
        put_array(f"{name}-vectors.npy", vectors)
        return pa.table({"width": pa.array([width], pa.int32()), "name": [name]})

    placed = sharded(anchors, BLOCK_VALUES, "block")
    done = placed.groupBy("width", "block").applyInArrow(write, "width int, name string")
    return [(r.width, r.name) for r in done.orderBy("name").collect()]


def searched(base: DataFrame, files, work, schema: str) -> DataFrame:
    """``work(lists, one list per label, anchor row, anchor)`` for every shard and anchor of its width."""
    named = {}
    for width, name in files:
        named.setdefault(width, []).append(name)

    def search(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = key[0].as_py()
        ids, labels, vectors = unpacked(pa.Table.from_batches(list(batches)), width)
        for name in named.get(width, []):
            keys, wanted = np.array(get_array(f"{name}-keys.npy")), np.array(get_array(f"{name}-vectors.npy"))
            values, anchors = together(quantised(vectors, work.scale), quantised(wanted, work.scale))
            whole = Lists(ids, labels, values)
            by_label = {}
            out = []
            for row, anchor in zip(keys, anchors):
                out += work(whole, by_label, row, anchor)
            if out:
                yield work.batch(out)

    return base.groupBy("width", "shard").applyInArrow(search, schema)


class Positives:
    """The first rows of the anchor's label in a shard."""

    def __init__(self, scale, k):
        self.scale, self.k = scale, k

    def __call__(self, whole, by_label, row, anchor):
        label = int(row[1])
        if label not in by_label:
            own = whole.labels == label
            by_label[label] = Lists(whole.ids[own], whole.labels[own], whole.values[own])
        ids, scores = positives_of(by_label[label], anchor, int(row[0]), self.k)
        return [(int(row[0]), int(i), int(s)) for i, s in zip(ids, scores)]

    @staticmethod
    def batch(rows):
        a, b, s = zip(*rows)
        return pa.RecordBatch.from_arrays([longs(a), longs(b), longs(s)], names=["anchor_id", "positive_id", "positive_score"])


class Negatives:
    """The first rows of other labels in each of the anchor's windows, in a shard."""

    def __init__(self, scale, k, low, high, unit):
        self.scale, self.k, self.share = scale, k, (low, high, unit)

    def __call__(self, whole, by_label, row, anchor):
        scores = sorted(set(row[3 : 3 + int(row[2])].tolist()))
        windows = [window_of(s, *self.share) for s in scores]
        found = negatives_of(whole, anchor, int(row[1]), windows, self.k)
        return [(int(row[0]), p, int(i), int(s)) for p, (ids, values) in zip(scores, found) for i, s in zip(ids, values)]

    @staticmethod
    def batch(rows):
        a, p, b, s = zip(*rows)
        return pa.RecordBatch.from_arrays([longs(a), longs(p), longs(b), longs(s)], names=["anchor_id", "positive_score", "negative_id", "negative_score"])


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, unit: int = 100, scale: int = 256,
    id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding", shard_values: int = SHARD_VALUES,
) -> DataFrame:
    """Hard negatives of every anchor and each of its positives.

    A component x counts as floor(``scale`` * x); a score is the whole-number inner product with
    the anchor; higher scores come first, ties to the smaller id. The positives of an anchor are its
    first ``positives`` other rows of its label. For each of them the first ``negatives`` rows of
    other labels with ``low`` * positive score <= ``unit`` * score <= ``high`` * positive score:
    ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``,
    ``negative_score``. All, if there are fewer; no row where there is none.

    Rows whose id, label or vector is null, or whose vector holds a null or non-finite component,
    take no part. Of rows with one id the first by label, then vector, counts. Vectors meet those
    of their own length only. An empty table gives an empty table; other columns are left out.
    A score beyond the range of a long raises.
    """
    spark = rows.sparkSession
    base = sharded(kept(usable(rows, id_column, label_column, vector_column), "vectors"), shard_values, "shard")
    asked = kept(usable(anchors, id_column, label_column, vector_column), "anchors")
    path = new_scratch(spark, "anchors")
    first = anchor_files(asked.withColumn("scores", F.array().cast("array<bigint>")), f"{path}/first")
    found = searched(base, first, Positives(scale, positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = kept(found.withColumn("place", place).where(F.col("place") <= positives).drop("place"), "positives")
    scores = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list("positive_score").alias("scores"))
    second = anchor_files(asked.join(scores, "id"), f"{path}/second")
    windows = searched(base, second, Negatives(scale, negatives, low, high, unit), "anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = windows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return chosen.join(ranked, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
