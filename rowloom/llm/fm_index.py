"""Benchmark decontamination with one FM-index per shard of the documents.

A shard is a slice of whole documents inside a task. Its words are numbered by the vocabulary of
the benchmark; a run of other words can be part of no occurrence and is kept as one separator.
Windows of the benchmark are searched backwards through the wavelet matrix of the Burrows-Wheeler
transform, occurrences are located by sampled suffix positions and merged into spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import carried, prepared
from rowloom.llm.kernels import ALNUM_WORD, LOWER, find_words, slices, sums_by_text, text_bytes, within, xxh64_words

# Words of the benchmark that are searched, and broadcast, at once.
BLOCK_WORDS = 1 << 19
# Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 1 << 23
# Distance of sampled positions within a run.
SAMPLE = 16


def suffix_order(symbols):
    """Order of all suffixes: prefix doubling in which only suffixes that still tie are sorted again.

    Every 0 is a separator and differs from all others, so no comparison goes past it.
    """
    n = len(symbols)
    gaps = symbols == 0
    separators = int(gaps.sum())
    rank = symbols + separators
    rank[gaps] = np.arange(separators)
    width = int(rank.max()).bit_length()
    step = 3 if 3 * width <= 62 else 2
    key = np.zeros(n, np.int64)
    for j in range(step):
        key <<= width
        key[: n - j] |= rank[j:]
    order = np.argsort(key, kind="stable")
    slots = np.arange(n)
    key = key[order]
    place = np.empty(n, np.int64)
    while len(slots):
        heads = np.concatenate([[True], key[1:] != key[:-1]])
        run = np.cumsum(heads) - 1
        place[order[slots]] = slots[heads][run]
        tied = np.bincount(run)[run] > 1
        slots = slots[tied]
        ids = order[slots]
        later = np.zeros(len(ids), np.int64)
        inside = ids + step < n
        later[inside] = place[ids[inside] + step] + 1
        key = place[ids] * (n + 2) + later
        by = np.argsort(key, kind="stable")
        order[slots] = ids[by]
        key = key[by]
        step *= 2
    return order


class ShardIndex:
    """FM-index of a sequence of words in which 0 separates; searches never contain 0."""

    def __init__(self, symbols, alphabet):
        n = len(symbols)
        order = suffix_order(symbols)
        last = np.where(order > 0, symbols[order - 1], 0)
        self.n, self.last = n, last
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        # wavelet matrix: per bit, zeros before every place and the number of all zeros
        self.levels = []
        row = last
        for bit in reversed(range(max(1, (alphabet - 1).bit_length()))):
            ones = (row >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - ones, dtype=np.int32)]).astype(np.int32)
            self.levels.append((bit, zeros))
            row = np.concatenate([row[ones == 0], row[ones == 1]])
        # sampled suffix positions: every SAMPLE words from the start of a run
        at = np.arange(n)
        head = np.maximum.accumulate(np.where(symbols == 0, at, -1)) + 1
        chosen = ((at - head) % SAMPLE == 0)[order]
        self.sampled = chosen
        self.sample_of = np.cumsum(chosen) - 1
        self.samples = order[chosen]

    def rank(self, symbol, place):
        """Number of ``symbol`` in the transform before ``place``."""
        begin = np.zeros_like(place)
        for bit, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            total = zeros[-1]
            begin = np.where(one, total + begin - zeros[begin], zeros[begin])
            place = np.where(one, total + place - zeros[place], zeros[place])
        return place - begin

    def search(self, patterns):
        """Rows of the suffixes that begin with each pattern: (pattern, from, to), empty ones left out."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in reversed(range(patterns.shape[1])):
            c = patterns[which, j]
            low, high = self.below[c] + self.rank(c, low), self.below[c] + self.rank(c, high)
            found = high > low
            which, low, high = which[found], low[found], high[found]
        return which, low, high

    def locate(self, rows):
        """Position in the sequence of the suffix of every row."""
        out = np.empty(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.samples[self.sample_of[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            c = self.last[rows]
            rows = self.below[c] + self.rank(c, rows)
            steps += 1
        return out


class Windows:
    """Distinct windows of some benchmark items, by length, in numbers of their vocabulary (from 1)."""

    def __init__(self, items, width):
        """items: (item id, word hashes)."""
        self.words = np.unique(np.concatenate([h for _, h in items] or [np.empty(0, np.uint64)]))
        self.names = [name for name, _ in items]
        rows: dict[int, list] = {}
        for i, (_, h) in enumerate(items):
            numbers = np.searchsorted(self.words, h) + 1
            length = min(width, len(numbers))
            if length:
                cut = np.lib.stride_tricks.sliding_window_view(numbers, length)
                rows.setdefault(length, []).append((cut, np.full(len(cut), i)))
        self.lengths = {}
        for length, found in rows.items():
            owner = np.concatenate([x[1] for x in found])
            windows, of = np.unique(np.concatenate([x[0] for x in found]), axis=0, return_inverse=True)
            by = np.argsort(of.ravel(), kind="stable")
            bounds = np.searchsorted(of.ravel()[by], np.arange(len(windows) + 1))
            self.lengths[length] = windows, owner[by], bounds
        self.shortest = min(self.lengths, default=1)

    @classmethod
    def of(cls, state):
        """The windows whose ``vars`` are given: what is broadcast is plain data."""
        out = cls.__new__(cls)
        vars(out).update(state)
        return out

    def occurrences(self, hashes, texts):
        """First word, length, and (text, item) pairs of all occurrences in the words of a shard."""
        at, known = within(hashes, self.words)
        number = np.where(known, at + 1, 0)
        # runs of known words of one text; those too short for any window become separators
        brk = np.concatenate([[True], (texts[1:] != texts[:-1]) | ~known[1:] | ~known[:-1]]) if len(texts) else np.empty(0, bool)
        run = np.cumsum(brk) - 1
        keep = known & (np.bincount(run, minlength=1)[run] >= self.shortest) if len(run) else known
        places = np.flatnonzero(keep)
        nothing = np.empty(0, np.int64)
        if not len(places):
            return nothing, nothing, nothing, nothing
        # one separator before each run
        heads = np.concatenate([[True], run[places][1:] != run[places][:-1]])
        spot = np.arange(len(places)) + np.cumsum(heads)
        symbols = np.zeros(spot[-1] + 2, np.int64)
        symbols[spot] = number[places]
        origin = np.full(len(symbols), -1)
        origin[spot] = places
        index = ShardIndex(symbols, len(self.words) + 1)
        begins, sizes, of_text, of_item = [nothing], [nothing], [nothing], [nothing]
        for length, (windows, owner, bounds) in self.lengths.items():
            which, low, high = index.search(windows)
            many = high - low
            rows = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            begin = origin[index.locate(rows)]
            begins.append(begin)
            sizes.append(np.full(len(begin), length))
            window, text = np.repeat(which, many), texts[begin]
            # distinct (text, window), then the items of each window
            pairs = np.unique(np.stack([text, window], axis=1), axis=0)
            owners = bounds[pairs[:, 1] + 1] - bounds[pairs[:, 1]]
            at = np.repeat(bounds[pairs[:, 1]], owners) + np.arange(owners.sum()) - np.repeat(np.cumsum(owners) - owners, owners)
            of_text.append(np.repeat(pairs[:, 0], owners))
            of_item.append(owner[at])
        return tuple(np.concatenate(x) for x in (begins, sizes, of_text, of_item))


def scan(batches, windows, fields, text_column):
    """Add the occurrences of one block of windows to what earlier blocks found."""
    for batch in batches:
        for part in slices(batch, text_column, SHARD_BYTES):
            data, bounds = text_bytes(part.column(text_column))
            low = LOWER[data]
            start, end, first = find_words(low, bounds, ALNUM_WORD)
            texts = np.repeat(np.arange(part.num_rows), np.diff(first))
            begin, size, of_text, of_item = windows.occurrences(xxh64_words(low, start, end), texts)
            change = np.zeros(len(start) + 1, np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + size, -1)
            before = [(t, s) for t, s in enumerate(part.column("spans").to_pylist()) if s]
            for t, spans in before:
                a = np.searchsorted(start, bounds[t] + np.array(spans[0::2]))
                z = np.searchsorted(start, bounds[t] + np.array(spans[1::2]))
                np.add.at(change, a, 1)
                np.add.at(change, z, -1)
            hit = np.cumsum(change[:-1]) > 0
            # spans: runs of hit words of one text
            other = np.concatenate([[True], (texts[1:] != texts[:-1])]) if len(texts) else np.empty(0, bool)
            opens = np.flatnonzero(hit & (other | ~np.concatenate([[False], hit[:-1]])))
            closes = np.flatnonzero(hit & (np.append(other[1:], True) | ~np.append(hit[1:], False))) if len(texts) else opens
            spans: list[list[int]] = [[] for _ in range(part.num_rows)]
            for t, a, z in zip(texts[opens], start[opens], end[closes]):
                spans[t] += [int(a - bounds[t]), int(z - bounds[t])]
            items = [set(x or ()) for x in part.column("items").to_pylist()]
            for t, i in set(zip(of_text.tolist(), of_item.tolist())):
                items[t].add(windows.names[i])
            columns = [part.column(f) for f in fields] + [
                pa.array(np.diff(first)),
                pa.array(sums_by_text(hit.astype(np.int64), first)),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*fields, "n_words", "n_hit", "items", "spans"])


def contamination(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text", item_column: str = "item_id", item_text: str = "text", width: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Where texts of a benchmark occur in documents; one row for every row of ``docs``.

    The columns ``carry``; ``n_words``; ``n_hit`` (words inside an occurrence of a window
    of ``width`` words, or of a whole shorter item); ``items`` (sorted ids of the items with an
    occurring window); ``spans`` (byte offsets from, to, from, to ... of the merged occurrences).
    Null and empty texts have no words and no hits. Items without words or id are left out;
    repeated ids count once, and items of equal text are spread over the blocks. A benchmark larger than ``block_words`` words is searched in blocks,
    each of which every task gets; an item is never split. Columns that are not
    carried, and carried ones named like a result column, are left out. Words are told apart by XXH64.
    """
    carry = carried(carry, "n_words", "n_hit", "items", "spans")
    kinds = dict(docs.select(*carry).dtypes)
    source = docs.select(*carry, F.col(f"`{text_column}`").cast("string").alias("__text"))
    wanted = prepared(benchmark, **{item_column: "string", item_text: "string"})

    def hashed(batches):
        for batch in batches:
            for part in slices(batch, item_text):
                data, bounds = text_bytes(part.column(item_text))
                low = LOWER[data]
                start, end, first = find_words(low, bounds, ALNUM_WORD)
                h = xxh64_words(low, start, end)
                rows = [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column(item_column), pa.array(rows, pa.binary()), pa.array(np.diff(first))], names=["item", "words", "n"])

    items = wanted.where(F.col(item_column).isNotNull()).mapInArrow(hashed, "item string, words binary, n bigint").where("n > 0").distinct()
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // block_words) or 1
    spark = docs.sparkSession
    found = source.select("*", F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<bigint>").alias("spans"))
    fields = [*carry, "__text"]
    state = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "__text string, n_words bigint, n_hit bigint, items array<string>, spans array<bigint>"])
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(vars(Windows([(r.item, np.frombuffer(r.words, np.uint64)) for r in rows], width)))
        found = found.select(*fields, "items", "spans").mapInArrow(lambda batches, s=shared: scan(batches, Windows.of(s.value), fields, "__text"), state)
    return found.drop("__text")


def contaminated():
    """The rule for documents to drop: hits in a twentieth of the words, one at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
