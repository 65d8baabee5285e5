"""License scans: MinHash over overlapping text windows, then exact containment.

Templates are grouped by length. For a group, the text is cut into windows twice as long as its
templates, each half overlapping the next, so a whole notice always lies in one window. Bands of
one MinHash value each retrieve templates: a window that shares the least value of a band with a
template. There are so many bands that a window with a notice is missed with a probability of at
most ``MISS``. What is retrieved is verified by exact shingle
containment.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowloom.llm.common import prepared
from rowloom.llm.kernels import LOWER, SPACED_WORD, find_words, hash_shingles, hash_words, mix64, slices, text_bytes

# Short public notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
SHINGLE = 5
CONTAINMENT = 0.8
# Probability that no band of a window with a notice agrees.
MISS = 1e-4


def group_of(shingles):
    """Exponent of the window half that holds so many shingles."""
    return max(0, (shingles - 1).bit_length())


def bands_for(half, sizes, containment, miss):
    """Bands of one value each that find notices of the least containment, but for ``miss``.

    Of n shingles of a template at least the containment's share lies in the window of
    2 * 2**half shingles, which bounds their Jaccard similarity from below.
    """
    least = min(need / ((2 << half) + n - need) for n in sizes for need in [ceil(containment * n)])
    return ceil(log(miss) / log(1 - least)) if least < 1 else 1


def shingle_hashes(column):
    """Shingle hashes of all texts, their bounds by text, and the bytes of the words."""
    data, bounds = text_bytes(column)
    low = LOWER[data]
    start, end, first = find_words(low, bounds, SPACED_WORD)
    words = np.diff(first)
    h = hash_words(low, start, end)
    every = hash_shingles(h, SHINGLE)
    keep = np.repeat(np.arange(len(words)), words)
    inside = keep[: len(every)] == keep[SHINGLE - 1 :] if len(every) else np.empty(0, bool)
    counts = np.maximum(words - SHINGLE + 1, 0)
    return every[inside], np.concatenate([[0], np.cumsum(counts)])


def band_values(hashes, band):
    """One hash function of each band: the upper half of a product with an odd number."""
    factor = int(mix64(np.array([band + 1], np.uint64))[0]) | 1
    return ((hashes * np.uint64(factor)) >> np.uint64(32)).astype(np.uint32)


class Library:
    """Distinct shingles and MinHash values of the templates, by group."""

    def __init__(self, templates, containment, miss):
        self.containment = containment
        self.groups: dict[int, list] = {}
        for name, text in sorted(templates.items()):
            h = np.unique(shingle_hashes(pa.array([text]))[0])
            if not len(h):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            self.groups.setdefault(group_of(len(h)), []).append((name, h))
        self.bands = {half: bands_for(half, [len(h) for _, h in found], containment, miss) for half, found in self.groups.items()}
        self.values = {half: [[band_values(h, b).min() for _, h in found] for b in range(self.bands[half])] for half, found in self.groups.items()}

    def candidates(self, hashes, bounds):
        """(group, template, text, window) of which a band agrees."""
        counts = np.diff(bounds)
        top = max(self.groups)
        # every text is filled up to whole blocks of the longest group, so no block has two texts
        filled = -(-counts // (1 << top)) << top
        begin = np.cumsum(filled) - filled
        spot = np.arange(len(hashes)) + np.repeat(begin - bounds[:-1], counts)
        found = set()
        for b in range(max(self.bands.values()) if len(hashes) else 0):
            least = np.full(filled.sum(), np.iinfo(np.uint32).max, np.uint32)
            least[spot] = band_values(hashes, b)
            for half in range(top + 1):
                if half:
                    least = np.minimum(least[0::2], least[1::2])
                if b < self.bands.get(half, 0):
                    # a window joins a block and the next one
                    for i, value in enumerate(self.values[half][b]):
                        for block in np.flatnonzero(least == value):
                            found |= {(half, i, int(block)), (half, i, int(block) - 1)}
        out = []
        for half, i, block in found:
            text = int(np.searchsorted(begin, block << half, "right")) - 1 if block >= 0 else -1
            if text >= 0:
                out.append((half, i, text, block - int(begin[text] >> half)))
        return sorted(out)

    def matches(self, hashes, bounds):
        """(text, template, first word of the window, containment) of all windows that hold a template."""
        out = []
        for half, i, text, window in self.candidates(hashes, bounds):
            name, shingles = self.groups[half][i]
            a, z = bounds[text] + (window << half), bounds[text + 1]
            share = np.isin(shingles, hashes[a : min(a + (2 << half), z)]).mean()
            if share >= self.containment:
                out.append((text, name, window << half, float(share)))
        return out


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_column: str = "doc_id", text_column: str = "text", containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """Windows of the texts that hold at least ``containment`` of a template's distinct shingles.

    ``id_column``, ``license``, ``window_start`` (first word of the window), ``containment``. A
    notice may lie in two overlapping windows. Shingles have ``SHINGLE`` lower-cased words; texts
    with fewer words, null and empty ones have no match; repeated rows match each for itself. Each
    template needs at least ``SHINGLE`` words. Other columns are left out.
    """
    source = prepared(docs, **{id_column: "bigint", text_column: "string"})
    templates = TEMPLATES if templates is None else templates

    def task(batches):
        library = Library(templates, containment, miss)
        for batch in batches:
            for part in slices(batch, text_column):
                hashes, bounds = shingle_hashes(part.column(text_column))
                rows = library.matches(hashes, bounds) if templates else []
                ids = part.column(id_column).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.float64())],
                    names=[id_column, "license", "window_start", "containment"],
                )

    return source.mapInArrow(task, f"{id_column} bigint, license string, window_start bigint, containment double")
