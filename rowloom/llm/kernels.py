"""Numpy helpers that run inside Spark tasks on Arrow batches of texts.

Texts are handled as one byte buffer per slice of a batch: words are found with byte tables,
word hashes come from prefix sums, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at once; a slice holds whole documents, one at least.
SLICE_BYTES = 1 << 22
# Bytes of text for which intermediate 64-bit values are held at once.
PIECE_BYTES = 1 << 20

BYTES = np.arange(256)
# [^\x20\x09-\x0D]+
SPACED_WORD = ~((BYTES == 0x20) | ((BYTES >= 0x09) & (BYTES <= 0x0D)))
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, letters taken after lower-casing
ALNUM_WORD = ((BYTES >= 0x30) & (BYTES <= 0x39)) | ((BYTES >= 0x61) & (BYTES <= 0x7A)) | (BYTES >= 0x80)
LOWER = np.where((BYTES >= 0x41) & (BYTES <= 0x5A), BYTES + 32, BYTES).astype(np.uint8)

RADIX = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def slices(batch, column="text", limit=SLICE_BYTES):
    """Parts of a record batch with at most ``limit`` bytes of text each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column):
    """Bytes of all texts, each closed by one space, and the bounds of each; null is empty."""
    n = len(column)
    nothing, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    column = pc.fill_null(column.cast(pa.large_string()), nothing)
    closed = pc.binary_join_element_wise(column, nothing, space)
    bounds = np.frombuffer(closed.buffers()[1], np.int64)[closed.offset : closed.offset + n + 1]
    data = np.frombuffer(closed.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def find_words(low, bounds, table):
    """Start and end of every word, and the first word of every text (one more at the end)."""
    inside = table[low]
    change = np.empty(len(low), bool)
    change[:1] = inside[:1]
    np.not_equal(inside[1:], inside[:-1], out=change[1:])
    edges = np.flatnonzero(change)
    # each text ends in a space, so every word has an end
    start, end = edges[0::2], edges[1::2]
    return start, end, np.searchsorted(start, bounds)


def mix64(h):
    """Spread the bits of unsigned 64-bit values (splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n):
    """RADIX to the power of 0 to n-1, and the inverses, modulo 2**64."""
    out = []
    for base in (RADIX, pow(RADIX, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p))
    return out


def hash_words(low, start, end):
    """A 64-bit hash of the bytes of every word."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    cuts = np.unique(np.searchsorted(start, np.arange(0, start[-1] + PIECE_BYTES + 1, PIECE_BYTES)))
    widest = max(int(end[b - 1] - start[a]) for a, b in zip(cuts[:-1], cuts[1:]))
    power, inverse = powers(widest + 1)
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = start[a]
        part = low[at : end[b - 1]].astype(np.uint64)
        part += np.uint64(1)
        part *= power[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        s, e = start[a:b] - at, end[a:b] - at
        out[a:b] = (sums[e] - sums[s]) * inverse[s]
    return mix64(out)


def hash_shingles(words, k):
    """A hash of every run of ``k`` word hashes, whatever text it lies in."""
    n = len(words) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        factor = 1
        for j in range(k):
            out += words[j : j + n] * np.uint64(factor)
            factor = factor * 0xD6E8FEB86659FD93 & MASK
    return mix64(out)


def texts_of(counts):
    """Number of the text of every word, from the number of words of every text."""
    return np.repeat(np.arange(len(counts)), counts)


def sums_by_text(values, first):
    """Sum of ``values`` over the words of every text; ``first`` has the bounds."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def within(keys, sorted_keys):
    """Position of every key in ``sorted_keys``, and whether it is there."""
    at = np.searchsorted(sorted_keys, keys)
    if not len(sorted_keys):
        return at, np.zeros(len(keys), bool)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == keys


P1, P2, P3, P4, P5 = (
    np.uint64(p)
    for p in (
        11400714785074694791,
        14029467366897019727,
        1609587929392839161,
        9650029242287828579,
        2870177450012600261,
    )
)


def rotated(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_of_length(words, at, length, seed):
    """XXH64 of the ``length`` bytes at each place; ``words`` has the 8 bytes from every place on."""

    def lane(v, x):
        return rotated(v + x * P2, 31) * P1

    seed = np.uint64(seed)
    place = at
    left = length
    if length >= 32:
        v = [np.full(len(at), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        while left >= 32:
            for i in range(4):
                v[i] = lane(v[i], words[place + 8 * i])
            place = place + 32
            left -= 32
        h = rotated(v[0], 1) + rotated(v[1], 7) + rotated(v[2], 12) + rotated(v[3], 18)
        for x in v:
            h = (h ^ lane(np.uint64(0), x)) * P1 + P4
    else:
        h = np.full(len(at), seed + P5, np.uint64)
    h += np.uint64(length)
    while left >= 8:
        h = rotated(h ^ lane(np.uint64(0), words[place]), 27) * P1 + P4
        place, left = place + 8, left - 8
    if left >= 4:
        h = rotated(h ^ (words[place] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
        place, left = place + 4, left - 4
    while left:
        h = rotated(h ^ (words[place] & np.uint64(0xFF)) * P5, 11) * P1
        place, left = place + 1, left - 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    return h


def xxh64(data, start, length, seed=42):
    """XXH64 of many byte ranges of ``data``, in their order."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,)).copy()
    out = np.empty(len(start), np.uint64)
    # short numbers sort faster
    length = length.astype(np.min_scalar_type(length.max(initial=0)))
    order = np.argsort(length, kind="stable")
    lengths, begins = np.unique(length[order], return_index=True)
    with np.errstate(over="ignore"):
        for n, a, b in zip(lengths, begins, [*begins[1:], len(order)]):
            rows = order[a:b]
            out[rows] = xxh64_of_length(words, start[rows], int(n), seed)
    return out


def xxh64_words(low, start, end):
    """XXH64 of the bytes of every word, by pieces of the text."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    cuts = np.unique(np.searchsorted(start, np.arange(0, start[-1] + PIECE_BYTES + 1, PIECE_BYTES)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = xxh64(low[start[a] : end[b - 1]], start[a:b] - start[a], end[a:b] - start[a:b])
    return out


def with_columns(batch, fields, **new):
    """A record batch of the named columns of ``batch`` and new ones."""
    columns = {f: batch.column(f) for f in fields} | {k: pa.array(v) for k, v in new.items()}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
