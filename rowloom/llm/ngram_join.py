"""Jaccard join of documents over word n-grams by grouped prefixes.

All sets are ordered alike, rare shingles first. Two sets as similar as asked share a shingle among
the first few of each, so only these prefixes are posted. Documents of the same size and prefix are
one group, and groups meet in the lists of their shingles; pairs of groups pass the filters on size
and position, are expanded to their members, pass a filter on how their shingles spread over 256
ranges of the hash, and are verified on the whole sets.

Documents of equal sets are one class from the start. Classes that may be linked, directly or by
others, are verified together, each set sent once, and give links that connect whatever is similar.
Families too large for a task are first linked in blocks; after that only pairs of classes that no
links connect so far are verified one by one. No pair that could still join two classes is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import kept, prepared
from rowloom.llm.components import star_components
from rowloom.llm.kernels import LOWER, SPACED_WORD, find_words, mix64, slices, sums_by_text, text_bytes, xxh64
from rowloom.scratch import small_side

# Cells of the table that estimates in how many documents a shingle is, sent to every task as a byte each.
CELLS = 1 << 20
# Shingles whose hashes are worked out at once.
SHINGLES_AT_ONCE = 1 << 18
# A list of more groups gives links that connect what may be similar; its pairs count only if a family is too large for a task.
CROWDED = 16
# Classes and shingles that are verified in one task at once; larger families are cut in blocks.
BLOCK = 4096
BLOCK_SHINGLES = 1 << 22
# How often each class of a larger family is dealt to a block.
DEALS = 3
# Classes outside a large family's largest component are sent to all its blocks if that is so many rows per class at most.
SPARE = 1
# Ranges of the hash over which the shingles of a set are counted, to a byte each.
RANGES = 256
# Lists of more entries are split, each part meets each other one.
LIST = 4096


def shingles(column, k):
    """XXH64 of the distinct shingles of every text, by text and hash, and how many each text has."""
    data, bounds = text_bytes(column)
    low = LOWER[data]
    start, end, first = find_words(low, bounds, SPACED_WORD)
    words = np.diff(first)
    # the words, each followed by one space
    keep = SPACED_WORD[low]
    low[end] = 0x20
    keep[end] = True
    closed = low[keep]
    length = end - start
    end = np.cumsum(length + 1) - 1
    start = end - length
    many = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    text = np.repeat(np.arange(len(words)), many)
    head = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    last = head + np.minimum(k, words)[text] - 1
    begin, stop = start[head], end[last]
    found = np.empty(len(text), np.uint64)
    for a in range(0, len(text), SHINGLES_AT_ONCE):
        part = slice(a, a + SHINGLES_AT_ONCE)
        low_end, high_end = begin[part][0], stop[part].max()
        found[part] = xxh64(closed[low_end:high_end], begin[part] - low_end, stop[part] - begin[part])
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[new], np.bincount(text[new], minlength=len(words))


def cells_of(hashes):
    return (hashes >> np.uint64(20)) & np.uint64(CELLS - 1)


def at_least(part, whole, size):
    """The least whole number that is ``part`` / ``whole`` of ``size``."""
    return -(-part * size // whole)


def probing_prefix(size, part, whole):
    """How many of a set's first shingles meet those of any set as similar as asked."""
    return size - at_least(part, whole, size) + 1


def indexing_prefix(size, part, whole):
    """The same for partners that are no smaller."""
    return size - at_least(2 * part, part + whole, size) + 1


def linked(common, size_a, size_b, part, whole):
    return whole * common >= part * (size_a + size_b - common)


def estimate(source, text_column, k):
    """Of every cell, the logarithm (base 2, rounded up) of the documents with a shingle in it, as a byte."""
    piece = 1 << 14

    def count(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in slices(batch, text_column):
                cells += np.bincount(cells_of(shingles(part.column(text_column), k)[0]).astype(np.int64), minlength=CELLS)
        for i in np.flatnonzero(cells.reshape(-1, piece).any(axis=1)):
            yield pa.RecordBatch.from_pydict({"piece": [int(i)], "counts": pa.array([cells[i * piece : (i + 1) * piece].tobytes()], pa.binary())})

    def add(batches):
        sums = {}
        for batch in batches:
            for i, counts in zip(batch.column("piece").to_pylist(), batch.column("counts")):
                sums[i] = sums.get(i, 0) + np.frombuffer(counts.as_buffer(), np.int64)
        for i, counts in sums.items():
            level = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"piece": [i], "counts": pa.array([level.tobytes()], pa.binary())})

    levels = np.zeros(CELLS, np.uint8)
    kind = "piece bigint, counts binary"
    for row in source.mapInArrow(count, kind).repartition("piece").mapInArrow(add, kind).collect():
        levels[row.piece * piece : (row.piece + 1) * piece] = np.frombuffer(row.counts, np.uint8)
    return levels


def binaries(values, bounds):
    """A binary column of the bytes of ``values`` between neighbouring ``bounds``."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def spreads(found, text, texts):
    """How the shingles of every text spread over the ranges of the hash; 255 stands for that or more."""
    counts = np.bincount(text * RANGES + (found >> np.uint64(56)).astype(np.int64), minlength=texts * RANGES)
    return np.minimum(counts, 255).astype(np.uint8)


def set_facts(source, id_column, text_column, k, levels, part, whole):
    """A row for every document: size, two digests of the set, its spread, the group (``node``) and the prefix."""

    def task(batches):
        for batch in batches:
            for piece in slices(batch, text_column):
                found, size = shingles(piece.column(text_column), k)
                first = np.concatenate([[0], np.cumsum(size)])
                text = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((found, levels.value[cells_of(found)], text))
                ordered = found[order]
                ahead = np.where(size > 0, probing_prefix(size, part, whole), 0)
                in_prefix = np.arange(len(found)) - first[text] < ahead[text]
                prefix, bounds = ordered[in_prefix], np.concatenate([[0], np.cumsum(ahead)])
                node = sums_by_text(mix64(prefix), bounds) + mix64(size.astype(np.uint64))
                raw = binaries(prefix, 8 * bounds)
                yield pa.RecordBatch.from_arrays([
                    piece.column(id_column), piece.column("text_hash"), pa.array(size, pa.int64()),
                    pa.array(sums_by_text(mix64(found), first).view(np.int64)),
                    pa.array(sums_by_text(mix64(found ^ np.uint64(0x5851F42D4C957F2D)), first).view(np.int64)),
                    pa.array(node.view(np.int64)), raw, binaries(spreads(found, text, len(size)), np.arange(len(size) + 1) * RANGES),
                ], names=["id", "text_hash", "n", "d0", "d1", "node", "prefix", "spread"])

    kind = "id bigint, text_hash bigint, n bigint, d0 bigint, d1 bigint, node bigint, prefix binary, spread binary"
    return source.mapInArrow(task, kind)


def posted(groups, levels):
    """An entry for every shingle of a group's prefix; ``busy``: its cell has more than LIST documents."""

    def task(batches):
        for batch in batches:
            raw = batch.column("prefix")
            sizes = np.asarray(pc.binary_length(raw), np.int64) // 8
            token = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
            group = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([
                pa.array(token.view(np.int64)), batch.column("node").take(pa.array(group)), batch.column("n").take(pa.array(group)),
                pa.array(place, pa.int64()), pa.array((levels.value[cells_of(token)] > np.log2(LIST))),
            ], names=["token", "node", "n", "place", "busy"])

    return groups.select("node", "n", "prefix").mapInArrow(task, "token bigint, node bigint, n bigint, place bigint, busy boolean")


def by_runs(batches, keys, most=None):
    """Rows of whole runs of equal ``keys`` (the first columns), as arrays of all columns; rows come sorted by them."""
    held = None
    for batch in batches:
        rows = [np.asarray(batch.column(i)) for i in range(batch.num_columns)]
        if held:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        if not len(rows[0]):
            continue
        same = np.ones(len(rows[0]), bool)
        for column in rows[:keys]:
            same &= column == column[-1]
        cut = int(len(same) - same[::-1].argmin()) if not same.all() else 0
        if cut:
            yield [x[:cut] for x in rows]
        held = [x[cut:] for x in rows]
    if held and len(held[0]):
        yield held


def run_edges(columns):
    change = np.zeros(len(columns[0]) - 1, bool)
    for column in columns:
        change |= column[1:] != column[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(columns[0])]])


def candidate_pairs(node, n, place, label, part, whole, role=None):
    """Pairs of entries of one list, sorted by size, that pass all filters and differ in label.

    ``role``: only pairs of one entry of role 0 and one of role 1 are wanted.
    """
    out = []
    upto = np.searchsorted(n, whole * n // part, "right")
    short = place < indexing_prefix(n, part, whole)
    for i in np.flatnonzero(short):
        j = np.arange(i + 1, upto[i])
        if not len(j):
            continue
        best = np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j])
        good = (node[j] != node[i]) & linked(best, n[i], n[j], part, whole)
        if label is not None:
            good &= (label[j] != label[i]) | (label[j] == 0)
        if role is not None:
            good &= role[j] != role[i]
        j = j[good]
        if len(j):
            out.append(np.stack([np.full(len(j), node[i]), node[j]]))
    return np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)


def pair_batch(pairs):
    low, high = np.minimum(pairs[0], pairs[1]), np.maximum(pairs[0], pairs[1])
    if len(low):
        low, high = np.unique(np.stack([low, high]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])


def lists_of(entries, part, whole):
    """Pairs of groups from every list of up to CROWDED entries; entries of longer lists as they are (``b`` null)."""

    def task(batches):
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64()), ("n", pa.int64()), ("place", pa.int64())])
        for token, n, node, place in by_runs(batches, 1):
            edges = run_edges([token])
            size = np.diff(edges)
            crowded = np.repeat(size > CROWDED, size)
            if crowded.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[crowded]), pa.nulls(int(crowded.sum()), pa.int64()), *(pa.array(x[crowded]) for x in (token, n, place))], schema=kind)
            pairs = [candidate_pairs(node[a:z], n[a:z], place[a:z], None, part, whole) for a, z in zip(edges[:-1], edges[1:]) if 1 < z - a <= CROWDED]
            if pairs:
                found = pair_batch(np.concatenate(pairs, axis=1))
                empty = pa.nulls(found.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*found.columns, empty, empty, empty], schema=kind)

    dealt = entries.select("token", "n", "node", "place").repartition("token").sortWithinPartitions("token", "n", "node")
    return dealt.mapInArrow(task, "a bigint, b bigint, token bigint, n bigint, place bigint")


def whole_sets(docs, wanted, id_column, text_column, k):
    """The columns of ``wanted`` and ``shingles`` (sorted hashes, 8 bytes each) of its classes, from the texts again.

    A class of repeated rows may come once from several tasks.
    """
    facts = [c for c in wanted.columns if c not in ("first_id", "text_hash")]

    def task(batches):
        seen = set()
        for batch in batches:
            fresh = []
            for cid in batch.column("cid").to_pylist():
                fresh.append(cid not in seen)
                seen.add(cid)
            for piece in slices(batch.filter(pa.array(fresh)), text_column):
                found, size = shingles(piece.column(text_column), k)
                raw = binaries(found, 8 * np.concatenate([[0], np.cumsum(size)]))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in facts), raw], names=[*facts, "shingles"])

    same = (F.col("text_hash") == F.col("wanted_hash")) & F.col(id_column).eqNullSafe(F.col("wanted_id"))
    named = wanted.withColumnsRenamed({"first_id": "wanted_id", "text_hash": "wanted_hash"})
    rows = docs.join(small_side(named, 64 * wanted.count()), same).select(*facts, text_column)
    return rows.mapInArrow(task, ", ".join(f"{c} bigint" for c in facts) + ", shingles binary")


def unpacked(column):
    """The sets of a binary column one after another, and their bounds."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64), np.concatenate([[0], np.cumsum([len(r) // 8 for r in raw])])


def links_in_block(cid, sets, part, whole, asked=None):
    """Components of what is similar in a block: (class, smallest class of its component) of all but these.

    One class after the other is compared with all, unless it was found similar to an earlier one;
    then those outside the largest component are compared too, so that no two components are left
    with a similar pair between them. ``asked``: only these are compared with all.
    """
    bounds = np.concatenate([[0], np.cumsum([len(s) // 8 for s in sets])])
    tokens, number = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
    size = np.diff(bounds)
    root = np.arange(len(cid))
    mark = np.zeros(len(tokens), np.int64)

    def compare(i):
        mine = number[bounds[i] : bounds[i + 1]]
        mark[mine] = 1
        shared = np.add.reduceat(mark[number], bounds[:-1])
        mark[mine] = 0
        hits = np.flatnonzero(linked(shared, size[i], size, part, whole))
        root[np.isin(root, np.unique(root[hits]))] = root[i]
        return hits

    if asked is None:
        free = np.ones(len(cid), bool)
        centre = np.zeros(len(cid), bool)
        # sets of commoner shingles first: the middle of a family rather than its edge
        common = np.add.reduceat(np.bincount(number, minlength=len(tokens))[number], bounds[:-1]) / size
        for i in np.argsort(-common, kind="stable"):
            if free[i]:
                centre[i] = True
                free[compare(i)] = False
        asked = ~centre & (root != np.bincount(root).argmax())
    for i in np.flatnonzero(asked):
        compare(i)
    least = np.full(len(cid), np.iinfo(np.int64).max)
    np.minimum.at(least, root, cid)
    least = least[root]
    return cid[least != cid], least[least != cid]


def linked_together(rows, keys, part, whole, asked=False):
    """Links inside every block: ``rows`` has the columns ``keys`` that name it, ``cid`` and ``shingles``.

    With ``asked`` they have a column of that name: only classes with 1 there are compared with all.
    """

    def task(batches):
        key, cid, raw, some = None, [], [], []

        def done():
            found = links_in_block(np.array(cid), raw, part, whole, np.array(some) == 1 if asked else None)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

        for batch in batches:
            names = zip(*(batch.column(x).to_pylist() for x in keys))
            flags = batch.column("asked").to_pylist() if asked else [1] * batch.num_rows
            for name, c, s, flag in zip(names, batch.column("cid").to_pylist(), batch.column("shingles").to_pylist(), flags):
                if key != name:
                    if len(cid) > 1:
                        yield done()
                    key, cid, raw, some = name, [], [], []
                if not cid or cid[-1] != c:
                    cid.append(c)
                    raw.append(s)
                    some.append(flag)
        if len(cid) > 1:
            yield done()

    wanted = rows.select(*keys, "cid", "shingles", *(["asked"] if asked else []))
    spread = wanted.repartition(*keys).sortWithinPartitions(*keys, "cid")
    return spread.mapInArrow(task, "a bigint, b bigint")


def linked_in_blocks(homes, members, sets, part, whole):
    """Links inside crowds: ``homes`` deals nodes to crowds, large crowds are cut in blocks of classes."""
    dealt = homes.join(members.select("node", "cid", "n"), "node").select("home", "deal", "cid", "n")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
    blocks = dealt.groupBy("home", "deal").agg(parts).where("blocks > 1")
    salt = F.pmod(F.xxhash64("cid", "deal", F.lit("block")), F.coalesce("blocks", F.lit(1)))
    rows = dealt.join(blocks, ["home", "deal"], "left").select("home", "deal", salt.alias("salt"), "cid").join(sets, "cid")
    return linked_together(rows, ["home", "deal", "salt"], part, whole)


def may_be_similar(left, right, n, m, part, whole):
    """Can sets with these spreads and sizes be as similar as asked?"""
    most = np.minimum(left, right)
    return linked(most.sum(axis=-1, dtype=np.int64), n, m, part, whole) | (most == 255).any(axis=-1)


def forest_of_list(cid, n, place, spread, part, whole, role):
    """Links that connect the classes of one list, sorted by size, which may be similar: one per class at most.

    ``role``: only pairs of one entry of role 0 and one of role 1 count.
    """
    upto = np.searchsorted(n, whole * n // part, "right")
    root = np.arange(len(cid))
    a, b = [], []
    for i in np.flatnonzero(place < indexing_prefix(n, part, whole)):
        j = np.arange(i + 1, upto[i])
        j = j[root[j] != root[i]]
        if role is not None:
            j = j[role[j] != role[i]]
        best = np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j])
        j = j[linked(best, n[i], n[j], part, whole)]
        j = j[may_be_similar(spread[i], spread[j], n[i], n[j], part, whole)] if len(j) else j
        roots, first = np.unique(root[j], return_index=True)
        a.append(np.full(len(roots), cid[i]))
        b.append(cid[j[first]])
        root[np.isin(root, roots)] = root[i]
    return (np.concatenate(a), np.concatenate(b)) if a else (cid[:0], cid[:0])


def crowd_links(crowded, classes, part, whole):
    """Links between the classes of crowded lists that connect what may be similar; no more than entries of a part."""
    entries = crowded.join(classes.select("node", "cid", "spread"), "node").select("token", "n", "cid", "place", "spread")
    parts = entries.groupBy("token").agg(F.ceil(F.count("*") / LIST).alias("parts"))
    placed = entries.join(parts, "token").withColumn("spot", F.pmod(F.xxhash64("cid"), F.col("parts")))
    # part x of a long list meets part y (x <= y) in a cell of their own
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    cells = cells.select("token", F.least("spot", "other").alias("x"), F.greatest("spot", "other").alias("y"), "n", "cid", "place", (F.col("spot") > F.col("other")).cast("int").alias("role"), "spread")

    def task(batches):
        key, rows = None, []

        def done():
            n, cid, place, role = (np.array(c) for c in zip(*(r[:4] for r in rows)))
            spread = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, RANGES)
            found = forest_of_list(cid, n, place, spread, part, whole, role if key[1] != key[2] else None)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("token", "x", "y", "n", "cid", "place", "role", "spread")]
            for name, row in zip(zip(*columns[:3]), zip(*columns[3:])):
                if name != key:
                    if len(rows) > 1:
                        yield done()
                    key, rows = name, []
                rows.append(row)
        if len(rows) > 1:
            yield done()

    dealt = cells.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "n", "cid")
    return dealt.mapInArrow(task, "a bigint, b bigint").distinct()


def promising(pairs, classes, part, whole):
    """The pairs ``a``, ``b`` of classes that may be similar by the spread of their shingles."""

    def task(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, RANGES) for c in ("left", "right"))
            good = may_be_similar(left, right, *(np.asarray(batch.column(c)) for c in ("n", "m")), part, whole)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    left = classes.select(F.col("cid").alias("a"), F.col("n").alias("n"), F.col("spread").alias("left"))
    right = classes.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("spread").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "left", "right").mapInArrow(task, "a bigint, b bigint")


def expanded(pairs, members):
    """Pairs of the classes of two groups, smaller number first; ``members`` has ``node``, ``cid``, ``root``: equal roots are left out."""
    sides = [members.select(F.col("node").alias(x), F.col("cid").alias(f"c{x}"), F.col("root").alias(f"r{x}")) for x in ("a", "b")]
    met = pairs.join(sides[0], "a").join(sides[1], "b").where("ra <> rb")
    return met.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))


def pairs_across(entries, part, whole):
    """Pairs of groups in one list that no links connect so far (``label`` differs; 0: of several kinds)."""
    varied = entries.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("entries"))
    varied = varied.where("low <> high or low = 0").select("token", F.ceil(F.col("entries") / LIST).alias("parts"))
    open_lists = entries.join(varied, "token")
    spot = F.pmod(F.xxhash64("node"), F.col("parts"))
    whole_lists = open_lists.where("parts = 1").select("token", F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), "n", "node", "place", "label", F.lit(0).alias("role"))
    # a long list: part x meets part y (x <= y) in a cell of their own
    split = open_lists.where("parts > 1").withColumn("spot", spot).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    split = split.select("token", F.least("spot", "other").alias("x"), F.greatest("spot", "other").alias("y"), "n", "node", "place", "label", (F.col("spot") > F.col("other")).cast("int").alias("role"))

    def task(batches):
        for token, x, y, n, node, place, label, role in by_runs(batches, 3):
            edges = run_edges([token, x, y])
            pairs = [
                candidate_pairs(*(c[a:z] for c in (node, n, place, label)), part, whole, role[a:z] if x[a] != y[a] else None)
                for a, z in zip(edges[:-1], edges[1:]) if z - a > 1
            ]
            if pairs:
                yield pair_batch(np.concatenate(pairs, axis=1))

    dealt = whole_lists.unionByName(split).repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "n", "node")
    return dealt.mapInArrow(task, "a bigint, b bigint").distinct()


def verified(pairs, sets, part, whole):
    """The pairs of classes whose whole sets are as similar as asked."""

    def task(batches):
        for batch in batches:
            (left, a), (right, b) = unpacked(batch.column("left")), unpacked(batch.column("right"))
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                mine, theirs = left[a[i] : a[i + 1]], right[b[i] : b[i + 1]]
                at = np.searchsorted(theirs, mine)
                at[at == len(theirs)] = 0
                good[i] = linked(int((theirs[at] == mine).sum()), len(mine), len(theirs), part, whole)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(task, "a bigint, b bigint")


def large_families(source, members, crowded, pairs, classes, id_column, text_column, k, part, whole):
    """Links that connect whatever is similar in families that do not fit a task.

    Each group of a crowded list is dealt to some of its lists, a group of several classes is a
    crowd itself, and crowds are linked in blocks. Where that leaves few classes outside a family's
    largest component, these are compared with all blocks of the family. In other families every pair
    of classes that met in a list or a group and that the links leave apart is verified.
    """
    sets = kept(whole_sets(source, members.select("cid", "first_id", "text_hash"), id_column, text_column, k), "whole-sets")
    here = crowded.join(members.select("node").distinct(), "node", "left_semi")
    picks = [F.min(F.struct(F.xxhash64("token", F.lit(d)).alias("h"), "token")).alias(f"p{d}") for d in range(DEALS)]
    deals = F.explode(F.array(*[F.struct(F.col(f"p{d}.token").alias("home"), F.lit(d).alias("deal")) for d in range(DEALS)])).alias("p")
    homes = here.groupBy("node").agg(*picks).select("node", deals).select("node", "p.home", "p.deal")
    several = members.groupBy("node").count().where("count > 1")
    several = several.select("node", F.col("node").alias("home"), F.explode(F.sequence(F.lit(DEALS), F.lit(2 * DEALS - 1))).alias("deal"))
    inner = kept(linked_in_blocks(homes.unionByName(several), members, sets, part, whole), "inner-links")
    roots = star_components(inner).select(F.col("node").alias("cid"), "root")
    labels = members.select("cid", "node", "family", "n").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    labels = kept(labels, "labels")

    by_root = labels.groupBy("family", "root").agg(F.count("*").alias("classes"), F.sum("n").alias("n"))
    of_family = by_root.groupBy("family").agg(F.sum("classes").alias("classes"), F.sum("n").alias("n"), F.max(F.struct("classes", "root")).alias("most"))
    parts = F.greatest(F.ceil(F.col("classes") / BLOCK), F.ceil(F.col("n") / BLOCK_SHINGLES))
    of_family = of_family.select("family", parts.alias("parts"), F.col("most.root").alias("most"), ((F.col("classes") - F.col("most.classes")) * parts <= SPARE * F.col("classes")).alias("merged"))
    labels = kept(labels.join(of_family, "family").withColumn("asked", (F.col("root") != F.col("most")).cast("int")), "labels")
    merged = labels.where("merged").select("family", "cid", "asked", "parts")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    own_part = merged.where("asked = 0").withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("parts")))
    dealt = own_part.unionByName(merged.where("asked = 1").withColumn("salt", every))
    beyond = kept(linked_together(dealt.join(sets, "cid"), ["family", "salt"], part, whole, asked=True), "inner-links")
    inner = inner.unionByName(beyond)
    labels = labels.where("not merged")
    here = here.join(labels.select("node").distinct(), "node", "left_semi")

    # a label for every group: its root, shifted clear of 0, or 0 for classes of several
    of_node = labels.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    of_node = of_node.select("node", F.when(F.col("low") == F.col("high"), F.col("low") + 1).otherwise(F.lit(0)).alias("label"))
    across = expanded(pairs_across(here.join(of_node, "node"), part, whole), labels)
    # of the classes of one group only those outside its largest component are paired with the others
    ranked = labels.join(of_node.where("label = 0").select("node"), "node", "left_semi").groupBy("node", "root").agg(F.count("*").alias("members"))
    largest = ranked.groupBy("node").agg(F.max_by("root", F.struct("members", "root")).alias("first"))
    outside = labels.join(largest, "node").where("root <> first").select("node", F.col("cid").alias("ca"), F.col("root").alias("ra"))
    beside = outside.join(labels.select("node", F.col("cid").alias("cb"), F.col("root").alias("rb")), "node").where("ra <> rb")
    beside = beside.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
    left, right = (labels.select(F.col("cid").alias(x), F.col("root").alias(f"r{x}")) for x in ("a", "b"))
    apart = pairs.join(left, "a").join(right, "b").where("ra <> rb").select("a", "b")
    asked = kept(apart.unionByName(promising(across.unionByName(beside).distinct(), classes, part, whole)).distinct(), "asked")
    return inner.unionByName(verified(asked, sets, part, whole))


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 4, part: int = 85, whole: int = 100) -> DataFrame:
    """``id_column``, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    A document is the set of its distinct shingles of ``k`` words, lower-cased A-Z; with fewer words
    the whole sequence is one shingle. Two documents link when ``whole`` times the common shingles
    are at least ``part`` times all shingles of both; ``component_id`` is the smallest id that links
    lead to, the row's own included.

    Null, empty and wordless texts have no shingles and link with nothing, not even each other.
    Repeated rows stay repeated. A row without an id is linked like any other but never names a
    component (null if no row of it has an id). An empty table gives an empty table; other columns
    are left out. Shingles are told apart by XXH64, sets by 128 bits of sums over it.
    """
    spark = docs.sparkSession
    source = prepared(docs, **{id_column: "bigint", text_column: "string"}).withColumn("text_hash", F.xxhash64(text_column))
    levels = spark.sparkContext.broadcast(estimate(source.select(text_column), text_column, k))
    facts = kept(set_facts(source, id_column, text_column, k, levels, part, whole), "sets")

    filled = facts.where("n > 0")
    first = F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("first")
    equal = filled.groupBy("d0", "d1").agg(first, F.max("n").alias("n"), F.max("node").alias("node"), F.max("spread").alias("spread"))
    equal = equal.select("d0", "d1", F.col("first.id").alias("first_id"), F.col("first.text_hash").alias("text_hash"), "n", "node", "spread")
    classes = kept(equal.withColumn("cid", F.monotonically_increasing_id()), "classes")
    groups = filled.groupBy("node").agg(F.max("n").alias("n"), F.max("prefix").alias("prefix"))

    entries = posted(groups, levels)
    busy = entries.where("busy").groupBy("token").agg(F.count("*").alias("entries"))
    busy_entries = entries.where("busy").join(busy.where("entries > 1"), "token")
    short = entries.where("not busy").select("token", "n", "node", "place").unionByName(
        busy_entries.where(F.col("entries") <= LIST).select("token", "n", "node", "place"))
    long = busy_entries.where(F.col("entries") > LIST).select(F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), "token", "n", "place")
    met = kept(lists_of(short, part, whole).unionByName(long), "met")
    crowded = met.where("b is null").select("token", F.col("a").alias("node"), "n", "place")

    # families: what may be linked, directly or by others
    own = classes.select("node", "cid", F.col("cid").alias("root"))
    pairs = kept(promising(expanded(met.where("b is not null").select("a", "b").distinct(), own).distinct(), classes, part, whole), "pairs")
    heads = classes.groupBy("node").agg(F.min("cid").alias("b"), F.count("*").alias("members"))
    same_group = classes.join(heads.where("members > 1"), "node").select(F.col("cid").alias("a"), "b")
    same_list = crowd_links(crowded, classes, part, whole)
    roots = star_components(pairs.unionByName(same_group).unionByName(same_list)).select(F.col("node").alias("cid"), F.col("root").alias("family"))
    roots = roots.unionByName(roots.select(F.col("family").alias("cid"), "family").distinct())
    related = kept(classes.join(roots, "cid").select("cid", "family", "node", "n", "first_id", "text_hash"), "families")
    fits = (F.count("*") <= BLOCK) & (F.sum("n") <= BLOCK_SHINGLES)
    sizes = related.groupBy("family").agg(fits.alias("fits"))
    placed = kept(related.join(sizes, "family"), "families")
    small = placed.where("fits").select("cid", "family", "first_id", "text_hash")
    links = kept(linked_together(whole_sets(source, small, id_column, text_column, k), ["family"], part, whole), "links")
    joined = links.toDF("node", "root")

    large = placed.where("not fits")
    if not large.isEmpty():
        joined = joined.unionByName(star_components(large_families(source, large, crowded, pairs, classes, id_column, text_column, k, part, whole)))
    rooted = classes.select("d0", "d1", "cid", "first_id").join(joined.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("d0", "d1", "component_id")
    alone = facts.where("n = 0").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return filled.join(named, ["d0", "d1"]).select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
