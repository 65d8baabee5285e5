"""Ranked search, hard negatives and the n-gram join against plain versions, and on odd input."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rowloom.llm import common, hard_negatives, ngram_join, ranked_search

DOCS = "doc_id bigint, text string, lang string, score double, rank int, n bigint, node bigint"
VECTORS = "vec_id bigint, label int, embedding array<float>, id string, rank int, score double"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, 0.5, 1, 2, 3) for i, t in rows], DOCS)


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def sentences(seed, n, vocabulary=60, longest=40):
    rng = random.Random(seed)
    names = [f"W{i}" if i % 3 else f"w{i}é" for i in range(vocabulary)]
    return [" ".join(rng.choices(names, weights=[1 / (i + 1) for i in range(vocabulary)], k=rng.randint(0, longest))) for _ in range(n)]


def edited(rng, text):
    words = text.split(" ")
    for _ in range(rng.randint(0, 2)):
        words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
    return " ".join(words)


ODD = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (5, "One"), (5, "other words entirely here now"), (None, "one two three four five"), (None, "one"), (7, "é-ü 12"), (8, "lorem Ipsum dolor " * 30_000)]


# ranked search


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(text))


def plain_search(docs, items, k):
    found = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, length = len(found), sum(size for _, _, size in found)
    df = Counter(t for _, counts, _ in found for t in counts)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, counts, size in found:
            m = 50 + 50 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 20 * m)) for t in wanted if counts[t])
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, rank, i, -score) for rank, (score, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"shard_bytes": 600, "block_terms": 20}])
@pytest.mark.parametrize("k", [1, 7])
def test_ranked_search(spark, limits, k):
    rows = ODD + [(100 + i // 2, t) for i, t in enumerate(sentences(1, 150))]
    asked = [(i, t) for i, t in enumerate(sentences(2, 25, 80, 12))] + [(3, "one w1é"), (None, "W1"), (60, None), (61, "nowhere"), (62, "Lorem é")]
    items = spark.createDataFrame([(i, t, 0.1, 5) for i, t in asked], "item_id int, text string, score double, rank int")
    found = ranked_search.ranked_search(documents(spark, rows).repartition(3), items, k, **limits)
    assert dict(found.dtypes) == {"item_id": "int", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, found.collect())) == plain_search(rows, asked, k)


def test_ranked_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert ranked_search.ranked_search(documents(spark, []), items).count() == 0
    assert ranked_search.ranked_search(documents(spark, ODD), items.limit(0)).count() == 0
    assert ranked_search.ranked_search(documents(spark, [(1, None), (2, "")]), items).count() == 0


def test_ranked_search_writes_few_files_whatever_the_shuffle_partitions(spark, monkeypatch):
    written = []

    def kept(*args):
        table = common.kept(*args)
        written.append(len(table.inputFiles()))
        return table

    monkeypatch.setattr(ranked_search, "kept", kept)
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {key: spark.conf.get(key) for key in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        rows = list(enumerate(sentences(1, 150)))
        asked = list(enumerate(sentences(2, 60, 80, 12)))
        found = ranked_search.ranked_search(documents(spark, rows), spark.createDataFrame(asked, "item_id bigint, text string"), 7)
        assert sorted(map(tuple, found.collect())) == plain_search(rows, asked, 7)
        at_once = common.tasks_at_once(spark)
        assert len(written) == 4 and max(written) <= at_once and found.rdd.getNumPartitions() <= at_once
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_search_stops_before_the_ends_of_the_lists():
    n = 50_000
    owner = np.repeat(np.arange(n), 2)
    lists = ranked_search.ImpactLists(owner, np.tile([0, 1], n), np.repeat(np.arange(n) ** 2 + 1, 2), n, 2)
    docs, scores = lists.top(np.array([0, 1]), 5, 0)
    assert len(docs) < 1000 and sorted(docs[np.argsort(-scores)][:5]) == [n - 5, n - 4, n - 3, n - 2, n - 1]


# hard negatives


def plain_negatives(rows, anchors, positives=5, negatives=10):
    good = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good[i] = min(good.get(i, (label, v)), (label, v))
    good = {i: (label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, (label, v) in good.items()}
    out = []
    for a in anchors & good.keys():
        label, mine = good[a]
        scored = sorted((-sum(x * y for x, y in zip(mine, v)), i, other) for i, (other, v) in good.items() if i != a and len(v) == len(mine))
        for p, i, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(s, j) for s, j, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(a, i, rank, j, -p, -s) for rank, (s, j) in enumerate(fits, 1)]
    return sorted(out)


def vector_rows(seed, n, width):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=width)
    return [(i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in (rng.normal(size=width) + centre) * 0.3]) for i in range(n)]


@pytest.mark.parametrize("shard_values", [1 << 19, 100])
def test_hard_negatives(spark, shard_values):
    rows = vector_rows(1, 180, 6) + [(1000 + i, label, v) for i, label, v in vector_rows(2, 30, 3)]
    rows += [(2000, 1, None), (2001, None, [0.1] * 6), (None, 1, [0.1] * 6), (2002, 1, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (2003, 1, [math.inf] * 6), (2004, 1, [math.nan] * 6)]
    rows += [(2010, 1, []), (2020, 2, []), (2030, 1, [0.0] * 6), rows[10], rows[10], (20, 0, rows[21][2]), (2040, 1, [1e6] * 6), (2050, 2, [4e5] * 6)]
    rows += [(3000 + i, i % 3, rows[40][2]) for i in range(40)]
    table = spark.createDataFrame([(*r, "id", 1, 0.5) for r in rows], VECTORS).repartition(3)
    found = hard_negatives.hard_negatives(table, table.where("vec_id % 10 = 0"), shard_values=shard_values)
    assert dict(found.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    want = plain_negatives(rows, {r[0] for r in rows if r[0] is not None and r[0] % 10 == 0})
    assert sorted(map(tuple, found.collect())) == want and len(want) > 100


def test_hard_negatives_of_nothing(spark):
    table = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(table, table).count() == 0
    alone = spark.createDataFrame([(10, 1, [0.5], "", 1, 0.5)], VECTORS)
    assert hard_negatives.hard_negatives(alone, alone).count() == 0


@pytest.mark.parametrize("size", [1.0, 2e7, 1e15, 1e30])
def test_scores_are_exact(size):
    rng = np.random.default_rng(3)
    left, right = hard_negatives.together(*(hard_negatives.quantised(rng.normal(size=(20, 8)) * s, 256) for s in (size, 1.0)))
    want = [sum(int(x) * int(y) for x, y in zip(row, right[0])) for row in left]
    assert [int(x) for x in left @ right[0]] == want


# n-gram join


def plain_join(rows, k=4, part=85, whole=100):
    sets = []
    for _, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", lower(text))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and whole * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if sets[i] and name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return sorted(((name, len(s), least.get(find(i)) if s else name) for i, ((name, _), s) in enumerate(zip(rows, sets))), key=repr)


def families(seed):
    """Texts of their own, copies, families of near copies, and a passage that many share."""
    rng = random.Random(seed)
    texts = sentences(seed, 60, 300, 60)
    base = [t for t in sentences(seed + 1, 8, 300, 60) if len(t.split()) > 30][:3]
    texts += [edited(rng, rng.choice(base)) for _ in range(120)]
    texts += [base[0]] * 20
    passage = " ".join(f"p{i}" for i in range(20))
    texts += [f"{passage} {' '.join(f'q{rng.randrange(10**6)}' for _ in range(rng.randint(0, 12)))}" for _ in range(60)]
    rng.shuffle(texts)
    return [(1000 + i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("limits", [{}, {"CROWDED": 3, "BLOCK": 6, "LIST": 16}, {"BLOCK": 40}, {"BLOCK_SHINGLES": 400, "LIST": 8, "SPARE": 9}])
def test_ngram_join(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = ODD + families(5)
    found = ngram_join.similar_documents(documents(spark, rows).repartition(3))
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}
    assert sorted(map(tuple, found.collect()), key=repr) == plain_join(rows)


@pytest.mark.parametrize("part", [50, 95])
def test_ngram_join_at_other_similarities(spark, part):
    rows = families(7)
    found = ngram_join.similar_documents(documents(spark, rows), k=2, part=part)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_join(rows, 2, part)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.similar_documents(documents(spark, [])).count() == 0
    empty = ngram_join.similar_documents(documents(spark, [(1, None), (2, ""), (None, "")]))
    assert sorted(map(tuple, empty.collect()), key=repr) == [(1, 0, 1), (2, 0, 2), (None, 0, None)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 20, 500])
def test_prefixes_are_long_enough(size):
    for other in range(size, 2 * size + 2):
        for common in range(1, size + 1):
            if ngram_join.linked(common, size, other, 85, 100):
                # the first common shingle is followed by the others in both sets
                assert size - common < ngram_join.indexing_prefix(size, 85, 100)
                assert other - common < ngram_join.probing_prefix(other, 85, 100)
