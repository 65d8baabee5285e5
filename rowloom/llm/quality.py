"""Quality scores by positive-unlabelled learning.

Trusted texts are the positives; unlabelled text of the corpus is a mixture of good and bad in
which the good ones have an estimated share, the class prior. A model that is additive over binned
measures of the text minimises the non-negative unbiased risk: the risk of bad texts is that of the
unlabelled ones less the prior's share of the positives', never below zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import carried, hash_share, labelled_sample, prepared
from rowloom.llm.kernels import LOWER, SPACED_WORD, find_words, hash_shingles, hash_words, slices, sums_by_text, text_bytes

# Rows of trusted positives and of unlabelled text to learn from; bins of each measure.
SAMPLE_ROWS = 10_000
UNLABELLED_ROWS = 30_000
BINS = 24
RIDGE = 1e-6
BYTES = np.arange(256)
UPPER = (BYTES >= 0x41) & (BYTES <= 0x5A)
LETTER = UPPER | ((BYTES >= 0x61) & (BYTES <= 0x7A)) | (BYTES >= 0x80)
DIGIT = (BYTES >= 0x30) & (BYTES <= 0x39)
MARK = (BYTES > 0x20) & ~LETTER & ~DIGIT & (BYTES != 0x7F)
PLAIN_MARK = np.isin(BYTES, [ord(c) for c in ".,;:'\"-()"])
MEASURES = 13


def measures(column):
    """Measures of every text: (texts, MEASURES)."""
    data, bounds = text_bytes(column)
    texts = len(bounds) - 1
    low = LOWER[data]
    start, end, first = find_words(low, bounds, SPACED_WORD)

    def share(mask, of):
        sums = np.concatenate([[0], np.cumsum(mask[data])])
        return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(of, 1)

    length = np.diff(bounds) - 1
    words = np.diff(first)
    some = np.maximum(words, 1)
    letters = share(LETTER, 1)
    text = np.repeat(np.arange(texts), words)
    h = hash_words(low, start, end)

    def repeated(values, of):
        """Share of the values of a text that occur in it before, and the largest share of one value."""
        order = np.lexsort((values, of))
        v, t = values[order], of[order]
        heads = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (t[1:] != t[:-1])])) if len(v) else np.empty(0, int)
        runs = np.diff(np.append(heads, len(v)))
        n = np.maximum(np.bincount(of, minlength=texts), 1)
        top = np.zeros(texts)
        np.maximum.at(top, t[heads], runs)
        return 1 - np.bincount(t[heads], minlength=texts) / n, top / n

    again, top = repeated(h, text)
    shingle = hash_shingles(h, 3)
    inside = text[: len(shingle)] == text[2:] if len(shingle) else np.empty(0, bool)
    shingles_again, _ = repeated(shingle[inside], text[: len(shingle)][inside])
    last = data[np.maximum(end - 1, 0)]
    odd_end = sums_by_text((MARK & ~PLAIN_MARK)[last].astype(np.int64), first) / some
    no_letter = sums_by_text((~LETTER[data[start]] & ~LETTER[last]).astype(np.int64), first) / some
    mean = sums_by_text((end - start).astype(np.int64), first) / some
    lines = share(BYTES == 0x0A, some)
    sentence = share(np.isin(BYTES, [ord(c) for c in ".!?"]), some)
    return np.column_stack([
        np.log1p(words), mean, share(UPPER, letters), share(MARK, length), share(MARK & ~PLAIN_MARK, length), share(DIGIT, length),
        again, top, np.where(words > 2, shingles_again, 0), odd_end, no_letter, lines, sentence,
    ])


def binned(x, edges):
    """One-hot bins of every measure, as column numbers."""
    return np.column_stack([np.searchsorted(e, x[:, i]) + i * BINS for i, e in enumerate(edges)])


def fit(positives, unlabelled, prior, steps=800):
    """Edges of the bins, weights and bias, by gradient steps on the non-negative risk."""
    both = np.concatenate([positives, unlabelled])
    edges = [np.unique(np.quantile(both[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(both.shape[1])]
    p, u = binned(positives, edges), binned(unlabelled, edges)
    size = both.shape[1] * BINS
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradient(rows, dz):
        flat = np.bincount(rows.ravel(), np.repeat(dz, rows.shape[1]), minlength=size)
        return np.append(flat, dz.sum())

    for t in range(1, steps + 1):
        zp, zu = w[p].sum(1) + w[size], w[u].sum(1) + w[size]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_negative = gradient(u, sigmoid(zu) / len(u)) - prior * gradient(p, sigmoid(zp) / len(p))
        if negative >= 0:
            g = prior * gradient(p, (sigmoid(zp) - 1) / len(p)) + of_negative
        else:
            g = -of_negative
        g[:size] += RIDGE * w[:size]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return edges, w[:size], float(w[size])


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", rows: int = SAMPLE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, prior: float | None = None) -> dict:
    """The model, from about ``rows`` trusted positives and ``unlabelled_rows`` of all rows of ``docs``.

    ``prior`` is the share of good texts; left out, it is estimated by the share of positives
    among the labelled ids and kept within 0.05 to 0.95. Without positives every score is 0.5.
    """
    given = prepared(labels, **{id_column: "bigint", label_column: "int"}).where(f"{id_column} is not null and {label_column} in (0, 1)")
    if prior is None:
        prior = given.agg(F.avg(label_column)).first()[0] or 0.0
    prior = min(max(prior, 0.05), 0.95)

    def task(batches):
        for batch in batches:
            for part in slices(batch):
                x = measures(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])

    def gathered(sample):
        found = sample.select("text").mapInArrow(task, "x binary").orderBy("x").toArrow().column("x").to_pylist()
        return np.frombuffer(b"".join(found)).reshape(-1, MEASURES)

    positives = gathered(labelled_sample(docs, given.where(f"{label_column} = 1"), id_column, text_column, label_column, rows))
    total = docs.count()
    texts = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("__id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    unlabelled = gathered(texts.where(hash_share(F.col("__id"), unlabelled_rows / max(total, unlabelled_rows))))
    if not len(positives) or not len(unlabelled):
        return {"edges": [], "weights": np.empty(0), "bias": 0.0, "prior": prior}
    edges, weights, bias = fit(positives, unlabelled, prior)
    return {"edges": edges, "weights": weights, "bias": bias, "prior": prior}


def score(docs: DataFrame, model: dict, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The columns ``carry`` and ``score`` (0 to 1) of every row; null counts as an empty text.

    A carried column named like a result column is left out.
    """
    carry = carried(carry, "score")
    kinds = dict(docs.select(*carry).dtypes)
    source = docs.select(*carry, F.col(f"`{text_column}`").cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        m = shared.value
        for batch in batches:
            for part in slices(batch, "__text"):
                z = np.full(part.num_rows, m["bias"])
                if m["edges"]:
                    z += m["weights"][binned(measures(part.column("__text")), m["edges"])].sum(1)
                columns = [part.column(c) for c in carry] + [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))]
                yield pa.RecordBatch.from_arrays(columns, names=[*carry, "score"])

    return source.mapInArrow(task, ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "score double"]))
