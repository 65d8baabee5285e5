"""Toxicity scores from a counterfactually regularised linear classifier.

The model is a logistic regression on the presence of hashed words and word beginnings. For each labelled text that
mentions an identity group, copies are made in which the term is swapped for others of its kind,
and the squared change of the logit between text and copy is added to the loss. What is said about
people moves the score, which people it is said about does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import carried, kept, labelled_sample, sample_shares
from rowloom.llm.kernels import ALNUM_WORD, LOWER, find_words, hash_words, mix64, slices, text_bytes

# Terms of one kind stand for each other.
IDENTITY_TERMS = {
    "religion": ["atheist", "buddhist", "catholic", "christian", "hindu", "jewish", "muslim", "protestant", "sikh"],
    "origin": ["african", "american", "arab", "asian", "black", "chinese", "european", "hispanic", "indian", "latino", "mexican", "white"],
    "orientation": ["bisexual", "gay", "heterosexual", "homosexual", "lesbian", "queer", "straight"],
    "gender": ["female", "male", "nonbinary", "transgender"],
    "people": ["boys", "girls", "men", "women"],
    "age": ["elderly", "middleaged", "old", "teenage", "young"],
    "ability": ["blind", "deaf", "disabled", "paralyzed"],
}
FEATURE_BITS = 20
# Bytes of the word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 6)
# Labelled rows of each label to learn from; features kept; texts a feature must occur in.
SAMPLE_ROWS = 8000
FEATURES = 4096
LEAST_TEXTS = 5
SWAPS = 3
# Weights of the penalties on changed logits and on the size of the coefficients.
FAIRNESS = 1.0
RIDGE = 1e-4


def feature_of(hashes):
    return (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def word_features(column):
    """Features of every word, (words, 1 + prefixes), and the bounds of the texts in words."""
    data, bounds = text_bytes(column)
    low = LOWER[data]
    start, end, first = find_words(low, bounds, ALNUM_WORD)
    found = [hash_words(low, start, end)]
    found += [mix64(hash_words(low, start, np.minimum(end, start + n)) + np.uint64(n)) for n in PREFIXES]
    return np.column_stack([feature_of(h) for h in found]), first


def term_features(terms):
    """Features of every identity term, (terms, features), by kind."""
    return [word_features(pa.array(kind))[0] for kind in terms.values()]


def distinct_features(features, first):
    """Distinct (text, feature) of all texts, as two arrays."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = np.unique(((text << FEATURE_BITS)[:, None] | features).ravel())
    return pair >> FEATURE_BITS, pair & ((1 << FEATURE_BITS) - 1)


def swapped(features, kinds):
    """Copies of a set of features in which each identity term gives way to others of its kind."""
    found = [(kind, i) for kind in kinds for i in np.flatnonzero(np.isin(kind[:, 0], features))]
    copies = []
    for step in range(1, SWAPS + 1) if found else ():
        gone = np.concatenate([kind[i] for kind, i in found])
        come = np.concatenate([kind[(i + step) % len(kind)] for kind, i in found])
        copies.append(np.union1d(np.setdiff1d(features, gone), come))
    return copies


def fit(rows, labels, pairs, k, counts_as, steps=300):
    """Weights and bias of ``k`` columns; ``rows`` are sets of columns, ``pairs`` (row, columns of a copy).

    A row counts as many times as ``counts_as`` says.
    """
    everything = rows + [c for _, c in pairs]
    n = len(rows)
    column = np.concatenate(everything)
    row = np.repeat(np.arange(len(everything)), [len(r) for r in everything])
    left = np.array([r for r, _ in pairs], int)
    right = n + np.arange(len(pairs))
    w, first, second = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    all_count = counts_as.sum()
    p = (counts_as * labels).sum() / all_count
    w[k] = np.log(p / (1 - p))
    for t in range(1, steps + 1):
        z = np.bincount(row, w[column], minlength=len(everything)) + w[k]
        dz = np.zeros(len(everything))
        dz[:n] = (1 / (1 + np.exp(-np.clip(z[:n], -30, 30))) - labels) * counts_as / all_count
        change = FAIRNESS * 2 * (z[left] - z[right]) * counts_as[left] / all_count
        np.add.at(dz, left, change)
        dz[right] -= change
        g = np.append(np.bincount(column, dz[row], minlength=k) + RIDGE * w[:k], dz.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return w[:k], float(w[k])


def informative(sets: DataFrame, share: float, weight: dict[int, float]) -> np.ndarray:
    """The ``FEATURES`` features that go most with the label (chi-squared), sorted.

    A row counts as the ``weight`` of its label, ``share`` is the share of toxic rows so counted. The
    variance is that of the rows there are, so larger weights alone make no feature significant.
    """

    def count(batches):
        n = np.zeros((2, 1 << FEATURE_BITS), np.int32)
        for batch in batches:
            for features, label in zip(batch.column("features").to_pylist(), batch.column("label").to_pylist()):
                n[label, np.frombuffer(features, "<i4")] += 1
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[1, at].astype(np.int64)), pa.array(n[:, at].sum(0))], names=["feature", "toxic", "n"])

    sums = sets.mapInArrow(count, "feature bigint, toxic bigint, n bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    toxic = F.col("toxic") * weight[1]
    n = toxic + (F.col("n") - F.col("toxic")) * weight[0]
    gap = toxic - n * share
    variance = n * share * (1 - share) * (weight[1] * (1 - share) + weight[0] * share)
    chi = sums.where(F.col("n") >= LEAST_TEXTS).withColumn("chi", gap * gap / variance).where("chi > 3.84")
    return np.sort(np.array([r.feature for r in chi.orderBy(F.desc("chi"), "feature").limit(FEATURES).select("feature").collect()], np.int64))


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", rows: int = SAMPLE_ROWS, terms: dict[str, list[str]] | None = None) -> dict:
    """The model, from about ``rows`` labelled documents of each label.

    Rows count as the inverse of their label's share in the sample, so scores keep to the labels' true shares.
    With rows of one label only, every score is that label; without any it is 0. Only the chosen
    features of the sampled rows and of their copies come to the driver, where the fit runs.
    """
    kinds = term_features(terms or IDENTITY_TERMS)

    def task(batches):
        for batch in batches:
            for part in slices(batch):
                text, feature = distinct_features(*word_features(part.column("text")))
                cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
                sets = [feature[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), part.column("label")], names=["features", "label"])

    shares = sample_shares(labels, id_column, label_column, rows)
    weight = {label: 1 / share for label, share in shares.items()}
    sample = labelled_sample(docs, labels, id_column, text_column, label_column, rows, shares)
    sets = kept(sample.mapInArrow(task, "features binary, label int"), "features")
    counts = {r.label: r["count"] for r in sets.groupBy("label").count().collect()}
    if len(counts) < 2:
        return {"features": np.empty(0, int), "weights": np.empty(0), "bias": 30.0 if counts.get(1) else -30.0}
    chosen = informative(sets, weight[1] * counts[1] / sum(weight[label] * n for label, n in counts.items()), weight)

    def columns(batches):
        for batch in batches:
            found, copies = [], []
            for raw in batch.column("features").to_pylist():
                features = np.frombuffer(raw, "<i4").astype(np.int64)
                versions = [np.flatnonzero(np.isin(chosen, v)).astype("<i2").tobytes() for v in [features, *swapped(features, kinds)]]
                found.append(versions[0])
                copies.append(versions[1:])
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary()), pa.array(copies, pa.list_(pa.binary()))], names=["label", "columns", "copies"])

    found = sets.mapInArrow(columns, "label int, columns binary, copies array<binary>").orderBy("columns", "label").toArrow()
    own = [np.frombuffer(b, "<i2").astype(np.int32) for b in found.column("columns").to_pylist()]
    pairs = [(i, np.frombuffer(c, "<i2").astype(np.int32)) for i, copies in enumerate(found.column("copies").to_pylist()) for c in copies]
    label = np.array(found.column("label").to_pylist(), float)
    weights, bias = fit(own, label, pairs, len(chosen), np.where(label == 1, weight[1], weight[0]))
    return {"features": chosen, "weights": weights, "bias": bias}


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
        weight = np.zeros(1 << FEATURE_BITS)
        weight[m["features"]] = m["weights"]
        used = np.zeros(1 << FEATURE_BITS, bool)
        used[m["features"]] = True
        for batch in batches:
            for part in slices(batch, "__text"):
                features, first = word_features(part.column("__text"))
                word, which = np.nonzero(used[features])
                text = np.searchsorted(first, word, "right") - 1
                pair = np.unique((text << FEATURE_BITS) | features[word, which])
                z = np.bincount(pair >> FEATURE_BITS, weight[pair & ((1 << FEATURE_BITS) - 1)], minlength=part.num_rows) + m["bias"]
                columns = [part.column(c) for c in carry] + [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))]
                yield pa.RecordBatch.from_arrays(columns, names=[*carry, "score"])

    return source.mapInArrow(task, ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "score double"]))
