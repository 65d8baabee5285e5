"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays.

The first pass over the texts counts words by hash and writes the hashes in sorted files; words are
numbered file by file, frequent ones first, so that n-grams of numbers compress well. The second pass counts n-grams of numbers and deals them to cells.
Each cell sums up its n-grams and writes them as a sorted file. All n-grams around a word lie in one
cell, so it also knows what they add to those one shorter (distinct words before, followers by count)
and writes that too; only n-grams around frequent words, which are spread, are sent on and added up.
The third pass maps these files into memory and scores every text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.arrays import get_array, local_path, put_array
from rowloom.llm.common import carried, kept, prepared, shuffles_dropped
from rowloom.llm.kernels import LOWER, SPACED_WORD, find_words, mix64, slices, text_bytes, within, xxh64
from rowloom.scratch import new_scratch

# The hash that stands for the end of a text.
END = np.uint64(0x2545F4914F6CDD1D)
# Longest n-grams of the model.
ORDER = 3
# Words of one file of the vocabulary; tokens whose n-grams a task gathers before it sends them on.
FILE_WORDS = 1 << 19
GATHERED = 1_500_000
# Tokens whose n-grams one cell should hold; n-grams around rarer words stay together in a cell.
CELL_TOKENS = 1 << 20
# Reducers at most; each takes its cells one after the other.
REDUCERS = 1 << 16
# Instead of a word's number: not in training, before the start of the text.
UNKNOWN, OUTSIDE = -1, -2
# Sums kept of what follows an n-gram: the counts of all, those that occur once, twice, more often.
FOLLOWERS = 4
# Sums kept of a word: distinct words before it, and those of what follows it.
SUMS = 1 + FOLLOWERS
# Entries from which a table leaves out the bits that the place in it tells, and how many those are.
SPLIT_ENTRIES, SPLIT_BITS = 1 << 17, 16
# Files that a task keeps mapped at most.
MAPPED = 1 << 14
ROWS = "level int, cell bigint, n bigint, data binary"


def token_hashes(column):
    """Hashes of the tokens of all texts, an end after each; the bounds of every text."""
    data, bounds = text_bytes(column)
    low = LOWER[data]
    start, end, first = find_words(low, bounds, SPACED_WORD)
    texts = len(bounds) - 1
    out = np.full(len(start) + texts, END, np.uint64)
    of = np.repeat(np.arange(texts), np.diff(first))
    out[np.arange(len(start)) + of] = xxh64(low, start, end - start)
    return out, first + np.arange(texts + 1)


def mixed_on(out, row):
    """``mixed`` of columns that have one number more, from that of what stands before it."""
    return mix64((out ^ row.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))


def mixed(rows):
    """A hash of every column of a table of whole numbers."""
    out = np.zeros(rows.shape[1], np.uint64)
    for row in rows:
        out = mixed_on(out, row)
    return out


def sorting(keys):
    """The order that sorts unsigned keys, and the sorted keys. The first bits of a key with its place behind sort faster than places do."""
    bits = np.uint64(max(len(keys) - 1, 0).bit_length())
    order = keys >> bits << bits
    order |= np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order &= (np.uint64(1) << bits) - np.uint64(1)
    order = order.view(np.int64)
    found = keys[order]
    if (found[1:] < found[:-1]).any():  # keys that differ in their last bits only
        again = np.argsort(found, kind="stable")
        order, found = order[again], found[again]
    return order, found


def changes(values):
    """Where another value begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)


def distinct_of(keys):
    """The distinct keys, sorted, and which of them every key is."""
    order, found = sorting(keys)
    heads = changes(found)
    of = np.empty(len(keys), np.int64)
    of[order] = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(keys)))
    return found[heads], of


@dataclass
class Model:
    """Where the arrays are, and the totals. All fields are plain values that travel with tasks."""

    path: str
    base: list[int]  # words before those of every vocabulary file, and the number of words
    shift: int  # bits that the file number leaves of a hash
    tokens: int
    order: int = ORDER
    cells: int = 1
    hot: int = 0  # n-grams whose inner words all occur more often are dealt one by one
    discounts: dict = field(default_factory=dict)  # by length
    pair_types: int = 0
    word_mass: float = 0.0

    @property
    def words(self):
        return self.base[-1]

    # A word's number is its place in its file, frequent ones first, with the number of the file in the last bits.
    @property
    def bits(self):
        return (len(self.base) - 2).bit_length()

    @property
    def start(self):
        """The number that stands for the start of a text, after all of the last file."""
        return (self.base[-1] - self.base[-2]) << self.bits | len(self.base) - 2

    def file(self, words):
        return words & (1 << self.bits) - 1


class Files:
    """The mapped arrays of a model in one task, opened when first needed."""

    def __init__(self, model):
        self.model, self.open, self.often = model, {}, None

    def get(self, name):
        """An array; beyond so many it is unmapped after use, unless it had to be copied."""
        if name in self.open:
            return self.open[name]
        path = f"{self.model.path}/{name}.npy"
        values = np.asarray(get_array(path))
        if len(self.open) < MAPPED or local_path(path) is None:
            self.open[name] = values
        return values

    def numbers(self, hashes):
        """Numbers of sorted distinct hashes, UNKNOWN where training has none."""
        m = self.model
        out = np.full(len(hashes), UNKNOWN, np.int64)
        cuts = np.searchsorted(hashes >> np.uint64(m.shift), np.arange(len(m.base), dtype=np.uint64)) if m.shift < 64 else np.array([0, len(hashes)])
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b and m.base[i] < m.base[i + 1]:
                at, known = within(hashes[a:b], self.get(f"hash-{i}"))
                out[a:b] = np.where(known, self.get(f"place-{i}")[at].astype(np.int64) << m.bits | i, UNKNOWN)
        return out

    def by_word(self, name, ids):
        """Values of an array, in files by vocabulary file, at numbers that come file by file (0 where unknown)."""
        m = self.model
        out = None
        cuts = np.searchsorted(m.file(ids), np.arange(len(m.base)))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                found = self.get(f"{name}-{i}")[ids[a:b] >> m.bits]
                if name == "word":
                    found = self.get(f"word-sums-{i}")[:, found]
                if out is None:
                    out = np.zeros((*found.shape[:-1], len(ids)), np.int64)
                out[..., a:b] = found
        return out if out is not None else np.zeros((SUMS, len(ids)) if name == "word" else len(ids), np.int64)

    def frequent(self, words):
        """Whether words occur so often that n-grams around them are spread; the start counts as one."""
        m = self.model
        if self.often is None:
            # a file has frequent words first
            counts = [self.get(f"count-{i}") if a < b else np.empty(0, int) for i, (a, b) in enumerate(zip(m.base[:-1], m.base[1:]))]
            self.often = np.array([len(count) - np.searchsorted(count[::-1], m.hot, "right") for count in counts])
        return (words >> m.bits < self.often[m.file(words)]) | (words == m.start)

    def cells(self, words, inner=None, level=None, key=None):
        """The cell of every n-gram, a column of ``words``; of single words, the vocabulary file.

        N-grams with the same inner words go to one cell, as they share what precedes and follows;
        those around words that are frequent in training are spread one by one.
        ``inner`` and ``level``: the words that the longer n-grams, of ``level`` words, around
        these have inside; what is not around rare words has numbers of ``model.cells`` on.
        ``key``: ``mixed`` of ``words``, where that is known.
        """
        m = self.model
        if len(words) == 1:
            return m.file(words[0]).astype(np.int64)
        own = inner is None
        if own:
            inner, level = words[1:-1], len(words)
        deal = mixed(words) if key is None else key.copy()
        rare = np.zeros(words.shape[1], bool)
        if len(inner):
            rare = ~np.logical_and.reduce([self.frequent(x) for x in inner])
            deal[rare] = mixed(inner[:, rare])
        cell = (mix64(deal + np.uint64(level)) % np.uint64(m.cells)).astype(np.int64)
        return cell if own else np.where(rare, cell, cell + m.cells)

    def gram_cells(self, words, key=None):
        """Where ``gram`` has n-grams: pairs stand with the triples around their first word."""
        return self.cells(words, words[:-1], 3, key) if len(words) == 2 < self.model.order else self.cells(words, key=key)

    def context_cells(self, words, key=None):
        """Where ``context`` has n-grams: with those one longer, whose inner words end them."""
        return self.cells(words, words[1:], len(words) + 1, key)

    def lookup(self, kind, words, key):
        """The sums of known n-grams of two words or more, which come in the order of ``key``; 0 where there are none."""
        out = np.zeros((1 if kind == "gram" else FOLLOWERS, len(key)), np.int64)
        cell = (self.gram_cells if kind == "gram" else self.context_cells)(words, key)
        cell = cell.astype(np.min_scalar_type(2 * self.model.cells))
        order = np.argsort(cell, kind="stable")
        cell, key = cell[order], key[order]
        begins = changes(cell)
        for a, b in zip(begins, [*begins[1:], len(order)]):
            name = f"{kind}-{len(words)}-{cell[a]}"
            try:
                at, hit = self.find(name, key[a:b])
            except FileNotFoundError:
                continue  # training has no n-gram in this cell
            # the sums at 0 are those of what is not there
            code = self.get(f"{name}-code")[at].astype(np.int64)
            code[~hit] = 0
            for row, values in zip(out, self.get(f"{name}-sums")):
                row[order[a:b]] = values[code]
        return out

    def find(self, name, keys):
        """Position of every key in a table that ``put_table`` wrote, and whether it is there."""
        begin, near = self.get(f"{name}-begin"), self.get(f"{name}-near")
        if not len(begin):
            return within(keys, self.get(f"{name}-key"))
        high, low = self.get(f"{name}-high"), self.get(f"{name}-low")
        first = (keys >> np.uint64(64 - SPLIT_BITS)).astype(np.int64)
        key_high = (keys >> np.uint64(16)).astype(np.uint32)
        key_low = keys.astype(np.uint16)
        at, end = (begin[x >> 8] + near[x].astype(np.int64) for x in (first, first + 1))
        size, last = end - at, len(high) - 1
        # the first place that has not less in its high bits, halving what is left of the keys with equal first bits
        for _ in range(int(size.max(initial=0)).bit_length()):
            half = size >> 1
            middle = at + half
            less = (high[np.minimum(middle, last)] < key_high) & (size > 0)
            at = np.where(less, middle + 1, at)
            size = np.where(less, size - half - 1, half)
        # of several with equal high bits, the one with the low bits
        while True:
            place = np.minimum(at, last)
            hit = (at < end) & (high[place] == key_high)
            on = hit & (low[place] < key_low)
            if not on.any():
                return place, hit & (low[place] == key_low)
            at = at + on


def put_table(name, key, sums):
    """Write sorted keys and their sums: of many keys 48 bits, as their places tell the first 16; sums as codes from 1."""
    if len(sums) == 1 and (most := sums.max(initial=0)) < 1 << 20:
        there = np.bincount(sums[0], minlength=most + 1) > 0
        distinct = np.flatnonzero(there)[None]
        code = np.cumsum(there)[sums[0]]
    else:
        _, first, code = np.unique(mixed(sums), return_index=True, return_inverse=True)
        distinct, code = sums[:, first], code + 1
    begin, near = np.empty(0, np.int64), np.empty(0, np.uint8)
    if len(key) >= SPLIT_ENTRIES:
        # where the keys with equal first bits begin: of every 256th in full, of others from there
        near = np.searchsorted(key >> np.uint64(64 - SPLIT_BITS), np.arange((1 << SPLIT_BITS) + 1, dtype=np.uint64))
        begin = near[::256].copy()
        near -= np.repeat(begin, 256)[: len(near)]
        put_array(f"{name}-high.npy", (key >> np.uint64(16)).astype(np.uint32))
        put_array(f"{name}-low.npy", key.astype(np.uint16))
    else:
        put_array(f"{name}-key.npy", key)
    put_array(f"{name}-begin.npy", begin)
    put_array(f"{name}-near.npy", near.astype(np.min_scalar_type(near.max(initial=0))))
    put_array(f"{name}-code.npy", code.astype(np.min_scalar_type(distinct.shape[1])))
    put_array(f"{name}-sums.npy", np.concatenate([np.zeros((len(sums), 1), np.int64), distinct], axis=1))


def put_contexts(name, key, sums):
    """Write what follows n-grams, but for those that one token follows once: whatever occurs is followed by that or by what is written."""
    more = sums[0] > 1
    if more.any():
        put_table(name, key[more], sums[:, more])


def grams(numbers, bounds, k, start):
    """The ``k`` words up to every token: ``start`` at the head of a text, OUTSIDE before it."""
    place = np.arange(len(numbers)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = np.full((k, len(numbers)), OUTSIDE, numbers.dtype)
    for row, back in zip(out, range(k - 1, -1, -1)):
        row[back:] = numbers[: len(numbers) - back]
        row[place == back - 1] = start
        row[place < back - 1] = OUTSIDE
    return out


def discounts(types):
    """Modified Kneser-Ney discounts from the numbers of types that occur 1, 2, 3 and 4 times."""
    n = [float(x) for x in types]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * y
        out.append(min(max(d, 0.0), float(k)))
    return tuple(out)


def discount_of(count, d):
    return np.array([0.0, *d])[np.clip(count, 0, 3)]


def mass_of(follow, d):
    """What the discounts take from the counts of all that follows."""
    return d[0] * follow[1] + d[1] * follow[2] + d[2] * follow[3]


def added(values, heads):
    """Sums of the runs of values that begin at ``heads``."""
    return np.add.reduceat(values, heads, dtype=np.int64) if len(heads) else np.empty(0, np.int64)


def summed(keys, counts):
    """Distinct keys, sorted, and the sum of their counts."""
    order, keys = sorting(keys)
    heads = changes(keys)
    return keys[heads], added(counts[order], heads)


def grouped(words):
    """Hashes of the distinct columns of ``words``, in order, these columns, the order of all and where each begins in it."""
    order, key = sorting(mixed(words))
    heads = changes(key)
    return key[heads], np.take(words, order[heads], axis=1), order, heads


def merged(words, sums=None):
    """Hashes of the distinct columns of ``words``, in order, these columns, and the added-up ``sums``; without these, how often each occurs."""
    key, distinct, order, heads = grouped(words)
    if sums is None:
        return key, distinct, np.diff(heads, append=len(order))[None]
    return key, distinct, np.stack([added(row[order], heads) for row in sums])


def packed(files, words, sums, cell=None, level=None):
    """A row for every cell: its n-grams and their sums, byte by byte so that they compress."""
    cell = files.cells(words) if cell is None else cell
    middle = len(words) // 2
    deal = cell * (int(words[middle].max(initial=0)) + 1) + words[middle]
    order, _ = sorting(deal.astype(np.uint64) << np.uint64(64 - max(1, int(deal.max(initial=0)).bit_length())))
    narrow = max(words.max(initial=0), sums.max(initial=0)) < 1 << 31
    table = np.empty((len(words) + len(sums), len(order)), np.int32 if narrow else np.int64)
    for row, values in zip(table, [*words, *sums]):
        row[:] = values[order]
    width, cell = table.itemsize, cell[order]
    begins = changes(cell)
    n, data = [], []
    for a, b in zip(begins, [*begins[1:], len(order)]):
        own = np.ascontiguousarray(table[:, a:b])
        own[middle] = np.diff(own[middle], prepend=0)
        planes = own.view(np.uint8).reshape(len(own), -1, width).transpose(0, 2, 1)
        n.append(b - a)
        data.append(bytes([width]) + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True))
    return as_rows([len(words) if level is None else level] * len(begins), cell[begins], n, data)


def unpacked(data, n, words, sums):
    rows, width = words + sums, data[0]
    planes = np.frombuffer(pa.decompress(memoryview(data)[1:], rows * n * width, "zstd", asbytes=True), np.uint8)
    table = planes.reshape(rows, width, n).transpose(0, 2, 1).copy().view(f"i{width}").reshape(rows, n)
    middle = words // 2
    np.cumsum(table[middle], out=table[middle])
    return table


def as_rows(level, cell, n, data):
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((level, cell, n, data), kinds)], names=["level", "cell", "n", "data"])


def train(docs: DataFrame, text_column: str = "text", order: int = ORDER) -> Model:
    """Count all rows of ``docs`` and write the model of n-grams up to ``order`` words, two at least.

    Null is an empty text, which still has an end. Repeated rows count as often as they occur.
    """
    if order < 2:
        raise ValueError("the order is two at least")
    texts = prepared(docs, **{text_column: "string"})
    with shuffles_dropped(docs.sparkSession):
        model = count_words(texts, text_column, order)
        return count_grams(model, texts, text_column) if model.words else model


def count_words(texts, text_column, order):
    """Count the words and write the vocabulary files."""
    path = new_scratch(texts.sparkSession, "model")

    def count(batches):
        hashes, counts = [], []

        def out():
            keys, sums = summed(np.concatenate(hashes), np.concatenate(counts))
            hashes.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], names=["h", "n"])

        for batch in batches:
            for part in slices(batch, text_column):
                h, n = np.unique(token_hashes(part.column(text_column))[0], return_counts=True)
                hashes.append(h)
                counts.append(n)
                if sum(map(len, hashes)) > GATHERED:
                    yield out()
        if hashes:
            yield out()

    counted = texts.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    counted = kept(counted, "words")
    words, tokens = counted.agg(F.count("*"), F.sum("n")).first()
    bits = max(0, (max(words, 1) // FILE_WORDS).bit_length())
    shift = 64 - bits

    def write_words(batches):
        held = {}
        for batch in batches:
            file, h, n = (np.asarray(batch.column(c)) for c in ("file", "h", "n"))
            for i in np.unique(file):
                held.setdefault(int(i), []).append((h[file == i], n[file == i]))
        for i, found in held.items():
            h, n = (np.concatenate(x) for x in zip(*found))
            h = h.view(np.uint64)
            order = np.argsort(h)
            h, n = h[order], n[order]
            often = np.argsort(-n, kind="stable")
            place = np.empty(len(h), np.uint32)
            place[often] = np.arange(len(h))
            put_array(f"{path}/hash-{i}.npy", h)
            put_array(f"{path}/place-{i}.npy", place)
            put_array(f"{path}/count-{i}.npy", n[often].astype(np.min_scalar_type(n.max())))
            yield pa.RecordBatch.from_pydict({"file": [i], "n": [len(h)]})

    file = F.shiftrightunsigned("h", shift) if bits else F.lit(0).cast("bigint")
    dealt = counted.select(file.alias("file"), "h", "n").repartition(1 << bits, "file")
    sizes = dict(dealt.mapInArrow(write_words, "file bigint, n bigint").collect())
    base = [0, *np.cumsum([sizes.get(i, 0) for i in range(1 << bits)]).tolist()]
    cells = max(1, -(-(tokens or 0) // CELL_TOKENS))
    return Model(path, base, shift, tokens or 0, order, cells, CELL_TOKENS // 8)


def count_grams(model, texts, text_column):
    """Count the longest n-grams, then pass down, length by length, what they add to shorter ones.

    N-grams that begin a text have no word before: their own count stands in for that of words
    before them, so shorter ones are counted there too.
    """
    path, base, longest = model.path, model.base, model.order
    kind = np.int32 if max(b - a for a, b in zip(base, base[1:])) + 1 << model.bits < 1 << 31 else np.int64

    def send(batches):
        mapped = Files(model)
        gathered: dict = {}
        tokens = 0

        def out():
            for k in list(gathered):
                words = np.concatenate(gathered.pop(k), axis=1)
                key, words, sums = merged(words)
                yield packed(mapped, words, sums, mapped.gram_cells(words, key))

        for batch in batches:
            for part in slices(batch, text_column):
                h, bounds = token_hashes(part.column(text_column))
                distinct, of = distinct_of(h)
                number = mapped.numbers(distinct).astype(kind)[of]
                for k in range(2, longest + 1):
                    words = grams(number, bounds, k, model.start)
                    counted = words[0] != OUTSIDE if k == longest else words[0] == model.start
                    gathered.setdefault(k, []).append(words[:, counted])
                tokens += len(h)
                if tokens > GATHERED:
                    yield from out()
                    tokens = 0
        if gathered:
            yield from out()

    def totals(level, seen):
        found = [(seen == k).sum() for k in (1, 2, 3, 4)] + [(seen > 0).sum(), seen.sum()]
        return as_rows([0] * 6, [level * 8 + i for i in range(6)], found, [b""] * 6)

    def followers(words, seen):
        """The n-grams one shorter and what follows them; their keys first."""
        key, shorter, order, heads = grouped(words[:-1])
        seen = seen[order]
        once, twice = added(seen == 1, heads), added(seen == 2, heads)
        return key, shorter, np.stack([added(seen, heads), once, twice, np.diff(heads, append=len(seen)) - once - twice])

    def finish_words(cell, table):
        _, words, sums = merged(table[:1], table[1:])
        yield totals(1, sums[0])
        _, first, code = np.unique(mixed(sums), return_index=True, return_inverse=True)
        # none has the code 0 but numbers that never occur
        codes = np.zeros(base[cell + 1] - base[cell] + (cell == len(base) - 2), np.min_scalar_type(len(first)))
        codes[words[0] >> model.bits] = code + 1
        put_array(f"{path}/word-{cell}.npy", codes)
        put_array(f"{path}/word-sums-{cell}.npy", np.concatenate([np.zeros((SUMS, 1), np.int64), sums[:, first]], axis=1))

    def finish_pairs(mapped, cell, key, words, seen):
        yield totals(2, seen[0])
        put_table(f"{path}/gram-2-{cell}", key, seen)
        last, before = merged(words[1:])[1:]
        first, after = followers(words, seen[0])[1:]
        # apart from each other: columns that are alike compress well
        yield packed(mapped, last, np.pad(before, ((0, FOLLOWERS), (0, 0))))
        yield packed(mapped, first, np.pad(after, ((1, 0), (0, 0))))

    def finish_grams(mapped, level, cell, table):
        """Write one cell and yield what it adds to shorter n-grams and to the totals."""
        key, words, seen = merged(table[:level], table[level:])
        if level == 2:
            yield from finish_pairs(mapped, cell, key, words, seen)
            return
        yield totals(level, seen[0])
        put_table(f"{path}/gram-{level}-{cell}", key, seen)
        key, shorter, sums = followers(words, seen[0])
        of = mapped.context_cells(shorter, key)
        here = of == cell
        put_contexts(f"{path}/context-{level - 1}-{cell}", key[here], sums[:, here])
        yield packed(mapped, shorter[:, ~here], sums[:, ~here], of[~here], 1 - level)
        key, shorter, sums = merged(words[1:])
        of = mapped.gram_cells(shorter, key)
        here = (of == cell) & (level == 3)
        yield packed(mapped, shorter[:, ~here], sums[:, ~here], of[~here])
        if here.any():
            yield from finish_pairs(mapped, cell, key[here], shorter[:, here], sums[:, here])

    def add_up(level):
        """Finish the cells of n-grams of ``level`` words and, where it is negative, of contexts."""

        def finish(mapped, kind, cell, found):
            table = np.concatenate(found, axis=1)
            found.clear()
            if kind < 0:
                key, _, sums = merged(table[:level], table[level:])
                put_contexts(f"{path}/context-{level}-{cell}", key, sums)
            elif level == 1:
                yield from finish_words(cell, table)
            else:
                yield from finish_grams(mapped, level, cell, table)

        def task(batches):
            mapped = Files(model)
            at, found = None, []
            for batch in batches:
                own = pc.equal(pc.abs(batch.column("level")), level)
                yield batch.filter(pc.invert(own))
                for row in batch.filter(own).to_pylist():
                    if (row["level"], row["cell"]) != at and found:
                        yield from finish(mapped, *at, found)
                        found = []
                    at = row["level"], row["cell"]
                    found.append(unpacked(row["data"], row["n"], level, SUMS if level == 1 else FOLLOWERS if row["level"] < 0 else 1))
            if found:
                yield from finish(mapped, *at, found)

        return task

    rows = texts.mapInArrow(send, ROWS)
    for level in range(longest, 0, -1):
        reducers = min(model.cells if level > 1 else len(base) - 1, REDUCERS)
        rows = rows.repartition(reducers, "cell").sortWithinPartitions("level", "cell").mapInArrow(add_up(level), ROWS)
    found = {r.cell: r.total for r in rows.where("level = 0").groupBy("cell").agg(F.sum("n").alias("total")).collect()}
    for level in range(1, longest + 1):
        model.discounts[level] = discounts([found[level * 8 + i] for i in range(4)])
    once, twice, types = found[8], found[9], found[12]
    d = model.discounts[1]
    model.pair_types = found[13]
    model.word_mass = d[0] * once + d[1] * twice + d[2] * (types - once - twice)
    return model


def score_tokens(files, hashes, bounds):
    """log10 probability, base log10 probability and training count of every token."""
    m = files.model
    distinct, of = distinct_of(hashes)
    ids = files.numbers(distinct)
    # numbers come file by file as the hashes do, unknown ones between them
    known = np.flatnonzero(ids >= 0)
    count = np.zeros(len(ids), np.int64)
    count[known] = files.by_word("count", ids[known])
    base = np.log10((count + 0.1) / (m.tokens + 0.1 * (m.words + 1)))[of]
    count = count[of]
    if not m.words:
        return np.zeros(len(hashes)), base, count
    # the last of the distinct words is the start, which stands before every text
    sums = np.zeros((SUMS, len(ids) + 1), np.int64)
    sums[:, known] = files.by_word("word", ids[known])
    sums[:, -1:] = files.by_word("word", np.array([m.start]))
    heads = bounds[:-1] + np.arange(len(bounds) - 1)
    token = np.ones(len(of) + len(heads), bool)
    token[heads] = False
    padded = np.full(len(token), len(ids))
    padded[token] = of
    seen, ids = sums[0], np.append(ids, m.start)
    p = ((seen - discount_of(seen, m.discounts[1]) + m.word_mass / (m.words + 1)) / m.pair_types)[padded]
    number, key = ids[padded], mixed(ids[None])[padded]
    after, mass = sums[1][padded], mass_of(sums[1:], m.discounts[2])[padded]
    for k in range(2, m.order + 1):
        # what follows the words before a token is what follows the n-gram that ends before it;
        # with nothing after the words before, there is no such n-gram
        asked = np.flatnonzero(token[1:] & (after[:-1] > 0)) + 1
        d = m.discounts[k]
        # nothing of an n-gram has an unknown word, those before the token occur as they stand
        there = asked[number[asked] >= 0]
        own = mixed_on(key[there - 1], number[there])
        order, own = sorting(own)
        there, head = there[order], changes(own)
        times, at = np.diff(head, append=len(own)), there[head]
        words = np.stack([number[at - back] for back in range(k - 1, -1, -1)])
        found = files.lookup("gram", words, own[head])[0]
        seen = np.zeros(len(token), np.int64)
        seen[there] = np.repeat(found, times)
        n, before = seen[asked], asked - 1
        p[asked] = (n - discount_of(n, d) + mass[before] * p[asked]) / after[before]
        if k < m.order:
            occurs = found > 0
            follow = np.zeros((FOLLOWERS, len(found)), np.int64)
            follow[:, occurs] = files.lookup("context", words[:, occurs], own[head][occurs])
            # what occurs and is not written is followed once (at the end of a text by nothing, which nobody asks)
            follow[:2, occurs & (follow[0] == 0)] = 1
            after, mass, key = np.zeros(len(token), np.int64), np.zeros(len(token)), np.zeros(len(token), np.uint64)
            after[there], mass[there], key[there] = np.repeat(follow[0], times), np.repeat(mass_of(follow, m.discounts[k + 1]), times), own
    return np.log10(p[token]), base, count


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The columns ``carry`` of every row and the scores of its text.

    ``n_tokens`` (words and one end), ``n_known`` (those that occur in training), ``base_score``
    (log10 of the smoothed unigram probability), ``score`` (log10 of the model's), ``perplexity``.
    Null is an empty text. With nothing to train on every token has probability 1.
    Carried columns named like a result column are left out.
    """
    carry = carried(carry, "n_tokens", "n_known", "base_score", "score", "perplexity")
    kinds = dict(docs.select(*carry).dtypes)
    source = docs.select(*carry, F.col(f"`{text_column}`").cast("string").alias("__text"))

    def task(batches):
        files = Files(model)
        for batch in batches:
            for part in slices(batch, "__text"):
                h, bounds = token_hashes(part.column("__text"))
                log_p, base, count = score_tokens(files, h, bounds)
                n = np.diff(bounds)
                total = np.add.reduceat(log_p, bounds[:-1])
                columns = [part.column(c) for c in carry] + [pa.array(x) for x in (n, np.add.reduceat((count > 0).astype(np.int64), bounds[:-1]), np.add.reduceat(base, bounds[:-1]), total, 10 ** np.minimum(-total / n, 300.0))]
                yield pa.RecordBatch.from_arrays(columns, names=[*carry, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "n_tokens bigint, n_known bigint, base_score double, score double, perplexity double"])
    return source.mapInArrow(task, schema)
