"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are cut into partitions of correlated bits. If the thresholds of the partitions, each
raised by one, sum to one more than the distance looked for, two fingerprints within that distance
agree up to the threshold in at least one partition. Each fingerprint gets its own thresholds, of
any size down to -1 (partition not probed), by dynamic programming on the candidates to expect;
then all values within its thresholds are looked up and every candidate is verified.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import kept, prepared
from rowloom.llm.components import star_components
from rowloom.llm.kernels import LOWER, SPACED_WORD, find_words, mix64, slices, text_bytes, with_columns, xxh64

# Shingles whose hashes are held as bits at once.
SHINGLES_AT_ONCE = 1 << 16
# Index entries of one bucket that are compared in one group; larger buckets are split.
BLOCK = 4096
# Cells of the table of estimated candidates, for each partition.
CELLS = 1 << 16
# Cost of a looked-up value, in comparisons.
PROBE_COST = 200


def simhash(low, bounds, k, seed=42):
    """64-bit fingerprint of every text: a bit is set if it is in over half the shingle hashes."""
    start, end, first = find_words(low, bounds, SPACED_WORD)
    words = np.diff(first)
    # the words, each followed by one space
    closed = low.copy()
    closed[end] = 0x20
    keep = SPACED_WORD[low]
    keep[end] = True
    closed = closed[keep]
    length = end - start
    end = np.cumsum(length + 1) - 1
    start = end - length
    shingles = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    text = np.repeat(np.arange(len(words)), shingles)
    head = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = head + np.minimum(k, words)[text] - 1
    begin, stop = start[head], end[last]
    ones = np.zeros((len(words), 64), np.int64)
    for a in range(0, len(text), SHINGLES_AT_ONCE):
        part = slice(a, a + SHINGLES_AT_ONCE)
        low_end, high_end = begin[part][0], stop[part].max()
        h = xxh64(closed[low_end:high_end], begin[part] - low_end, stop[part] - begin[part], seed)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        t = text[part]
        heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        ones[t[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    majority = 2 * ones > shingles[:, None]
    return np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 4) -> DataFrame:
    """``id_column`` and ``fingerprint`` (long) of every row, from its whole lower-cased text.

    Null and wordless texts have fingerprint 0; a text of fewer than ``k`` words is one shingle.
    """
    source = prepared(docs, **{id_column: "bigint", text_column: "string"})

    def task(batches):
        for batch in batches:
            for part in slices(batch, text_column):
                data, bounds = text_bytes(part.column(text_column))
                found = simhash(LOWER[data], bounds, k)
                yield with_columns(part, [id_column], fingerprint=found.view(np.int64))

    return source.mapInArrow(task, f"{id_column} bigint, fingerprint bigint")


def correlated_groups(together, n, parts):
    """Positions of the 64 bits in ``parts`` groups, bits that go together in one group.

    ``together[i, j]`` counts the fingerprints with both bits among ``n``.
    """
    p = together / max(n, 1)
    mean = np.diag(p)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tie = np.abs((p - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, groups = list(range(64)), []
    for i in range(parts):
        size = (64 - sum(map(len, groups))) // (parts - i)
        group = [max(free, key=lambda b: tie[b, free].max())]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: tie[b, group].sum())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def part_values(fp, groups):
    """Value of every fingerprint in every group of bits: (groups, fingerprints)."""
    out = np.zeros((len(groups), len(fp)), np.uint64)
    for i, group in enumerate(groups):
        for place, bit in enumerate(group):
            out[i] |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return out


def cells_of(values, part):
    return (mix64(values + np.uint64(part << 40)) % np.uint64(CELLS)).astype(np.int64)


def thresholds(values, groups, counts, distance, widest=2):
    """Threshold of every group for every fingerprint: (groups, fingerprints), from -1 on.

    Thresholds raised by one sum to ``distance`` + 1 and have the least cost of looked-up values
    and expected candidates, found by dynamic programming over the groups.
    """
    n = values.shape[1]
    total = distance + 1
    best = np.full((total + 1, n), np.inf)
    best[0] = 0
    chosen = []
    for i, group in enumerate(groups):
        width = len(group)
        exact = counts[i][cells_of(values[i], i)].astype(float)
        near = exact.copy()
        for b in range(width):
            near += counts[i][cells_of(values[i] ^ np.uint64(1 << b), i)]
        cost = [np.zeros(n), PROBE_COST + exact, PROBE_COST * (1 + width) + near]
        cost += [PROBE_COST * sum(comb(width, j) for j in range(t + 1)) + near * width / t for t in range(2, widest + 1)]
        new = np.full_like(best, np.inf)
        pick = np.zeros(best.shape, np.int64)
        for raised, extra in enumerate(cost):
            for s in range(raised, total + 1):
                better = best[s - raised] + extra < new[s]
                new[s] = np.where(better, best[s - raised] + extra, new[s])
                pick[s] = np.where(better, raised, pick[s])
        best = new
        chosen.append(pick)
    left = np.full(n, total)
    out = np.empty(values.shape, np.int64)
    for i in reversed(range(len(groups))):
        raised = chosen[i][left, np.arange(n)]
        out[i] = raised - 1
        left = left - raised
    return out


def signatures(fp, groups, counts, distance):
    """Bucket, role and fingerprint of all entries. Roles: 0 index, 1 index and probe, 2 probe."""
    values = part_values(fp, groups)
    limit = thresholds(values, groups, counts, distance)
    rows = []
    for i, group in enumerate(groups):
        lead = np.uint64(i << 40)
        rows.append((values[i] | lead, (limit[i] >= 0).astype(np.int8), fp))
        flips = [np.uint64(1 << b) for b in range(len(group))]
        one, two = limit[i] >= 1, limit[i] >= 2
        variants = [(one, f) for f in flips] + [(two, a | b) for x, a in enumerate(flips) for b in flips[:x] if two.any()]
        for rows_of, flip in variants:
            if rows_of.any():
                near = (values[i][rows_of] ^ flip) | lead
                rows.append((near, np.full(len(near), 2, np.int8), fp[rows_of]))
    return [np.concatenate(x) for x in zip(*rows)]


def links_of_group(index, probes, distance):
    """Links that join whatever the probes connect: at most one for each index entry and probe."""
    own = {int(f): i for i, f in enumerate(index)}
    label = np.arange(len(index))
    out = []
    for f in probes:
        hits = np.flatnonzero(np.bitwise_count(index ^ f) <= distance)
        at = own.get(int(f))
        for c in np.unique(label[hits]):
            if at is not None and label[at] == c:
                continue
            other = index[hits[np.flatnonzero(label[hits] == c)[0]]]
            if other != f:
                out.append((f, other))
        if len(hits):
            ids = np.unique(label[hits] if at is None else np.append(label[hits], label[at]))
            if len(ids) > 1:
                label[np.isin(label, ids)] = ids[0]
    return out


def compare(batches, distance, small=12):
    """Verified links within every (bucket, block); rows come sorted by bucket, block and role."""

    def linked(key, role, fp):
        # rows of whole groups; small groups are compared by shifting the rows
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        many = np.repeat(size > small, size)
        k, r, f = key[~many], role[~many], fp[~many]
        a, b = [], []
        for shift in range(1, small):
            same = np.flatnonzero((k[shift:] == k[:-shift]) & ((r[shift:] > 0) | (r[:-shift] > 0)) & ((r[shift:] < 2) | (r[:-shift] < 2)))
            hit = same[(np.bitwise_count(f[same] ^ f[same + shift]) <= distance) & (f[same] != f[same + shift])]
            a.append(f[hit])
            b.append(f[hit + shift])
        large = []
        for s, e in zip(edge[:-1][size > small], edge[1:][size > small]):
            large += links_of_group(np.unique(fp[s:e][role[s:e] < 2]), np.unique(fp[s:e][role[s:e] > 0]), distance)
        if large:
            x, y = np.array(large, np.uint64).T
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    held = None
    for batch in batches:
        bucket, block, role, fp = (np.asarray(batch.column(c)) for c in ("bucket", "block", "role", "fingerprint"))
        key = np.empty(len(fp), [("bucket", np.int64), ("block", np.int64)])
        key["bucket"], key["block"] = bucket, block
        rows = [key, role, fp.view(np.uint64)]
        if held:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        last = np.flatnonzero(rows[0] != rows[0][-1])
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield linked(*[x[:cut] for x in rows])
        held = [x[cut:] for x in rows]
        if len(held[0]) > 16 * BLOCK and held[1][-1] == 2:
            # the index entries of this group are complete: probe them piece by piece
            yield linked(*held)
            held = [x[held[1] < 2] for x in held]
            held[1] = np.zeros(len(held[1]), np.int8)
    if held and len(held[0]):
        yield linked(*held)


def near_links(prints: DataFrame, distance: int = 4, parts: int | None = None) -> DataFrame:
    """Links ``a``, ``b`` that connect all fingerprints within ``distance`` bits of each other.

    ``prints`` has distinct values in ``fingerprint``. Two fingerprints within the distance are in
    the same component of the links; not every such pair is a row, as a group of thousands of near
    copies has millions of pairs. ``parts`` is the number of groups of bits; left out, the number
    of fingerprints decides by the cost of look-ups and of candidates in evenly filled buckets.
    """
    spark = prints.sparkSession

    def count_bits(batches):
        sums, n = np.zeros((64, 64)), 0
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            sums += bits.T @ bits
            n += len(fp)
        yield pa.RecordBatch.from_pydict({"i": [-1, *np.repeat(np.arange(64), 64)], "j": [-1, *np.tile(np.arange(64), 64)], "n": [float(n), *sums.ravel()]})

    together = np.zeros((64, 64))
    n = 0
    for i, j, found in prints.select("fingerprint").mapInArrow(count_bits, "i bigint, j bigint, n double").groupBy("i", "j").agg(F.sum("n")).collect():
        if i < 0:
            n = found
        else:
            together[i, j] = found

    def looked_up(parts):
        spare = distance + 1 - parts
        even = [spare // parts + (i < spare % parts) for i in range(parts)]
        return sum(comb(64 // parts, j) for t in even for j in range(t + 1))

    if parts is None:
        parts = min(range(2, distance + 2), key=lambda m: looked_up(m) * (PROBE_COST + n / 2 ** (64 // m)))
    groups = correlated_groups(together, n, parts)

    def count_cells(batches):
        sums = np.zeros((parts, CELLS), np.int64)
        for batch in batches:
            for i, v in enumerate(part_values(np.asarray(batch.column(0)).view(np.uint64), groups)):
                np.add.at(sums[i], cells_of(v, i), 1)
        part, cell = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"part": part, "cell": cell, "n": sums[part, cell]})

    counts = np.zeros((parts, CELLS), np.int64)
    table = prints.select("fingerprint").mapInArrow(count_cells, "part bigint, cell bigint, n bigint").groupBy("part", "cell").agg(F.sum("n").alias("n"))
    for batch in table.toArrow().to_batches():
        part, cell, found = (np.asarray(batch.column(c)) for c in ("part", "cell", "n"))
        counts[part, cell] = found
    shared = spark.sparkContext.broadcast(counts)

    def enter(batches):
        for batch in batches:
            bucket, role, fp = signatures(np.asarray(batch.column(0)).view(np.uint64), groups, shared.value, distance)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(role), pa.array(fp.view(np.int64))], names=["bucket", "role", "fingerprint"])

    entries = prints.select("fingerprint").mapInArrow(enter, "bucket bigint, role tinyint, fingerprint bigint")
    entries = kept(entries, "entries")
    hot = entries.where("role < 2").groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    hot = hot.select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    marked = entries.join(hot, "bucket", "left")
    spot = F.pmod(F.xxhash64("fingerprint"), F.coalesce("blocks", F.lit(1)))
    cool = marked.where("blocks is null").select("bucket", F.lit(0).cast("bigint").alias("block"), "role", "fingerprint")
    held = marked.where("blocks is not null and role < 2").select("bucket", spot.alias("block"), F.lit(0).cast("tinyint").alias("role"), "fingerprint")
    sent = marked.where("blocks is not null and role > 0").select(
        "bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.lit(2).cast("tinyint").alias("role"), "fingerprint"
    )
    dealt = cool.unionByName(held).unionByName(sent).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "role")
    return dealt.mapInArrow(lambda batches: compare(batches, distance), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 4, distance: int = 4, parts: int | None = None) -> DataFrame:
    """``id_column``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs``.

    Rows whose fingerprints differ in at most ``distance`` bits are linked; ``component_id`` is
    the smallest id that links lead to, the row's own included. Null and empty texts have
    fingerprint 0 and are linked like any other. Repeated rows stay repeated; a row without an id
    stays in its component and never names it (null if no row of the component has an id). An
    empty table gives an empty table. Other columns are left out.
    """
    printed = kept(fingerprints(docs, id_column, text_column, k), "prints")
    distinct = kept(printed.groupBy("fingerprint").agg(F.min(id_column).alias("first_id")), "distinct")
    roots = star_components(near_links(distinct, distance, parts))
    rooted = distinct.join(roots.select(F.col("node").alias("fingerprint"), "root"), "fingerprint", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    found = printed.join(named, "fingerprint")
    return found.select(id_column, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
