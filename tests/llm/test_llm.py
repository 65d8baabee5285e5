"""The operators of rowloom.llm against plain versions, and on odd input."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from check_queries import compare, duck
from rowloom.llm.common import kept
from rowloom.llm import fm_index, kernels, kneser_ney, language, license_scan, mixing, permutation_index, quality, simhash, token_files, toxicity
from rowloom.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, h string, `a b` int"
LONG = "lorem ipsum Dolor " * 20_000
TEXTS = [None, "", "   \n", "a", "A  b\tC", "one two three four five six", "one two three four five six", LONG, "é ü ß", "12 34", "x" * 70_000]
ROWS = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 1, 0.5, "h", 1) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", "s", 1, 0.5, "h", 1), (None, "one", None, "s", 1, 0.5, "h", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", lower(text))


@pytest.mark.parametrize("name", list(SQL))
def test_query_against_sql(spark, name):
    assert compare(spark, duck(SF_DIR), QUERIES[name], SQL[name], SF_DIR) is None


def test_xxh64_of_all_lengths():
    data = np.frombuffer(bytes(range(256)) * 2, np.uint8)
    length = np.arange(200)
    start = length * 7 % 251
    want = [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), seed=42) for s, n in zip(start, length)]
    assert kernels.xxh64(data, start, length).tolist() == want


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    monkeypatch.setattr(kernels, "PIECE_BYTES", 16)
    data, bounds = kernels.text_bytes(pa.array(["ab cd ab", None, "cd " + "z" * 50, "ab"]))
    start, end, first = kernels.find_words(data, bounds, kernels.SPACED_WORD)
    h = kernels.hash_words(data, start, end)
    assert first.tolist() == [0, 3, 3, 5, 6]
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3


# op10


def plain_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(prints, distance):
    """Smallest position in the component of each fingerprint."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash_against_brute_force(docs):
    rows = sorted(simhash.near_duplicates(docs).collect())
    texts = dict(docs.select("doc_id", "text").collect())
    prints = [plain_fingerprint(texts[r.doc_id]) for r in rows]
    assert [int(r.fingerprint, 16) for r in rows] == prints
    want = [rows[i].doc_id for i in plain_components(prints, 4)]
    assert [r.component_id for r in rows] == want


@pytest.mark.parametrize("parts", [2, 3, 4, 5])
def test_links_of_crowded_fingerprints(spark, monkeypatch, parts):
    monkeypatch.setattr(simhash, "BLOCK", 20)
    rng = np.random.default_rng(parts)
    seeds = rng.integers(0, 1 << 64, 4, dtype=np.uint64)
    prints = {int(s) for s in seeds} | {int(rng.integers(0, 1 << 64, dtype=np.uint64)) for _ in range(50)}
    for s in seeds:
        for _ in range(60):
            flips = sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 8))})
            prints.add(int(s) ^ flips)
    prints = sorted(prints)
    table = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fingerprint bigint")
    from rowloom.llm.components import star_components

    links = simhash.near_links(table, 4, parts)
    got = {r.node: r.root for r in star_components(links).collect()}
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    want: dict = {}
    for i, r in enumerate(plain_components(prints, 4)):
        want.setdefault(r, []).append(signed[i])
    found: dict = {}
    for p in signed:
        found.setdefault(got.get(p, p), []).append(p)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_simhash_odd_input(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS)
    assert {by[i].fingerprint for i in (0, 1, 2)} == {"0" * 16} and by[2].component_id == 0
    assert by[6].component_id == 5 and sum(r.doc_id == 5 for r in rows) == 2
    assert simhash.near_duplicates(none).collect() == []


# op6


def plain_hits(text, windows):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    hit, items = set(), set()
    for item, window in windows:
        for i in range(len(w) - len(window) + 1):
            if w[i : i + len(window)] == window:
                hit |= set(range(i, i + len(window)))
                items.add(item)
    return len(w), len(hit), sorted(items)


@pytest.mark.parametrize("block_words", [1 << 19, 40])
def test_contamination_in_blocks_against_brute_force(spark, block_words):
    rng = np.random.default_rng(1)
    pool = ["ab", "cd", "éf", "g1", "h"]

    def some(n):
        return [pool[i] for i in rng.integers(0, 5, n)]

    items = [(f"q{i}", some(n)) for i, n in enumerate((20, 15, 3, 2, 13, 1))] + [("q0", some(14)), (None, some(4)), ("none", [])]
    texts = [" ".join(some(40)) for _ in range(20)] + ["X, " + "; ".join(items[i][1]).upper() + " zz." for i in range(6)]
    texts += [None, "", "-- !!", " ".join(items[0][1][:12]), " ".join(["ab"] * 3000)]
    benchmark = spark.createDataFrame([(i, " ".join(w), 1) for i, w in items], "item_id string, text string, spans int")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    windows = [(i, w[a : a + min(13, len(w))]) for i, w in items if w and i for a in range(max(1, len(w) - 12))]
    rows = fm_index.contamination(docs, benchmark, block_words=block_words).collect()
    for r in rows:
        n, hit, found = plain_hits(texts[r.doc_id], windows)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, found), r.doc_id
        cut = [texts[r.doc_id].encode()[a:b] for a, b in zip(r.spans[0::2], r.spans[1::2])] if r.spans else []
        assert sum(len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(c.decode()))) for c in cut) == hit
    assert len(rows) == len(texts)


def test_suffix_order():
    rng = np.random.default_rng(0)
    for n in (1, 2, 30, 200):
        s = np.append(rng.integers(0, 3, n), 0)
        gap = np.cumsum(s == 0)
        key = [[(0, int(gap[j])) if s[j] == 0 else (1, int(s[j])) for j in range(i, len(s))] for i in range(len(s))]
        assert fm_index.suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: key[i])


def test_contamination_odd_input(spark, odd, none):
    items = spark.createDataFrame([("x", "one two three"), (None, "a"), ("y", None)], "item_id string, text string")
    rows = fm_index.contamination(odd, items, carry=("doc_id", "score", "a b")).collect()
    assert len(rows) == len(ROWS) and {r.n_hit for r in rows if r.doc_id in (5, 6)} == {3}
    assert fm_index.contamination(none, items).collect() == []
    assert {r.n_hit for r in fm_index.contamination(odd, items.limit(0)).collect()} == {0}


def test_contamination_tells_words_of_equal_polynomial_hashes_apart(spark):
    x, y = "a", "b"
    for _ in range(11):
        x, y = x + y, y + x
    table = spark.createDataFrame([(1, x, "t"), (2, y, "t")], "doc_id int, text string, items string")
    rows = fm_index.contamination(table, table.where("doc_id = 1"), carry=("doc_id", "items"), item_column="doc_id").collect()
    assert {r.doc_id: (r.n_hit, r["items"]) for r in rows} == {1: (1, ["1"]), 2: (0, [])}


def test_carried_columns_give_way_to_results(odd, docs):
    trained = kneser_ney.train(odd)
    labels = odd.selectExpr("doc_id", "int(doc_id % 2) quality", "int(doc_id % 2) toxic")
    for found in (
        kneser_ney.score(odd, trained, carry=("doc_id", "score")),
        language.predict(odd, language.learn(docs), carry=("doc_id", "score")),
        quality.score(odd, quality.learn(odd, labels), carry=("doc_id", "score")),
        toxicity.score(odd, toxicity.learn(odd, labels), carry=("doc_id", "score")),
    ):
        assert found.columns.count("score") == 1 and found.count() == len(ROWS)
        assert any(r.score != 0.5 for r in found.select("score").collect()) or found.columns == ["doc_id", "score"]


# op5


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_against_brute_force(docs, order):
    held = {i for (i,) in docs.select("doc_id").collect() if zlib.crc32(str(i).encode()) % 10 == 0}
    texts = {i: words(t) + ["</s>"] for i, t in docs.select("doc_id", "text").collect()}
    train = [t for i, t in texts.items() if i not in held]
    one = Counter(w for t in train for w in t)
    total = sum(one.values())
    # seen[k]: counts of the longest n-grams; of shorter ones the words before, or the count at the head of a text
    seen = {order: Counter(g for t in train for g in zip(*[(["<s>"] + t)[i:] for i in range(order)]))}
    for k in range(order - 1, 0, -1):
        seen[k] = Counter(g[1:] for g in seen[k + 1])
        if k > 1:
            seen[k] += Counter(("<s>", *t[: k - 1]) for t in train if len(t) >= k - 1)
    cut = {k: kneser_ney.discounts([list(c.values()).count(n) for n in (1, 2, 3, 4)]) for k, c in seen.items()}
    after, mass = Counter(), Counter()
    for k in range(2, order + 1):
        for g, n in seen[k].items():
            after[g[:-1]] += n
            mass[g[:-1]] += cut[k][min(n, 3) - 1]
    rest = sum(cut[1][min(n, 3) - 1] for n in seen[1].values()) / (len(one) + 1)

    def p(*g):
        n = seen[len(g)][g]
        n -= cut[len(g)][min(n, 3) - 1] if n else 0
        if len(g) == 1:
            return (n + rest) / sum(seen[1].values())
        return (n + mass[g[:-1]] * p(*g[1:])) / after[g[:-1]] if after[g[:-1]] else p(*g[1:])

    model = kneser_ney.train(docs.where(~F.col("doc_id").isin(sorted(held))), order=order)
    rows = kneser_ney.score(docs, model).collect()
    assert model.tokens == total and len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(t), sum(w in one for w in t))
        assert math.isclose(r.base_score, sum(math.log10((one[w] + 0.1) / (total + 0.1 * (len(one) + 1))) for w in t), rel_tol=1e-9)
        padded = ["<s>"] + t
        assert math.isclose(r.score, sum(math.log10(p(*padded[max(0, i + 1 - order) : i + 1])) for i in range(1, len(padded))), rel_tol=1e-9)
    context = next(g[:-1] for t in train for g in zip(*[t[i:] for i in range(order)]))
    assert math.isclose(sum(p(*context, w) for w in one) + p(*context, "unheard-of"), 1)


def test_words_with_equal_polynomial_hashes(spark):
    x, y = "a", "b"
    for _ in range(11):
        x, y = x + y, y + x
    model = kneser_ney.train(spark.createDataFrame([(1, x)], "doc_id int, text string"))
    found = kneser_ney.score(spark.createDataFrame([(1, x), (2, y)], "doc_id int, text string"), model)
    assert {r.doc_id: r.n_known for r in found.collect()} == {1: 2, 2: 1}


@pytest.mark.parametrize("n", [1, 5000, kneser_ney.SPLIT_ENTRIES + 77])
def test_kneser_ney_tables(tmp_path, n):
    rng = np.random.default_rng(n)
    key = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    key[: len(key) // 3] >>= np.uint64(12)  # crowded first bits
    key = np.unique(key)
    sums = rng.integers(1, 400, (1, len(key)))
    kneser_ney.put_table(f"{tmp_path}/x", key, sums)
    files = kneser_ney.Files(kneser_ney.Model(str(tmp_path), [0, 1], 64, 1))
    absent = np.setdiff1d(np.concatenate([key + np.uint64(1), key ^ np.uint64(1 << 15), key ^ np.uint64(1 << 40), rng.integers(0, 1 << 64, n, dtype=np.uint64)]), key)
    asked = rng.permutation(np.concatenate([key, absent, np.array([0, (1 << 64) - 1], np.uint64)]))
    at, hit = files.find("x", asked)
    assert (hit == np.isin(asked, key)).all() and (key[at[hit]] == asked[hit]).all()
    assert (files.get("x-sums")[:, files.get("x-code")[at[hit]]] == sums[:, at[hit]]).all()
    if n > kneser_ney.SPLIT_ENTRIES:
        assert sum(f.stat().st_size for f in tmp_path.iterdir()) < 9.5 * len(key)


def test_kneser_ney_asks_once(spark, monkeypatch):
    """A slice looks up every distinct n-gram once, however often it occurs."""
    texts = ["one two three four"] * 50 + ["one two one two"] * 30
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    asked = []
    find = kneser_ney.Files.find
    monkeypatch.setattr(kneser_ney.Files, "find", lambda files, name, keys: (asked.append((name.rsplit("-", 1)[0], len(keys))), find(files, name, keys))[1])
    kneser_ney.score_tokens(kneser_ney.Files(model), *kneser_ney.token_hashes(pa.array(texts)))
    tokens = [t.split() + ["</s>"] for t in texts]
    pairs, triples = ({g for t in tokens for g in zip(*[(["<s>"] + t)[i:] for i in range(k)])} for k in (2, 3))
    sums = Counter()
    for kind, n in asked:
        sums[kind] += n
    assert (sums["gram-2"], sums["gram-3"]) == (len(pairs), len(triples)) and sums["context-2"] <= len(pairs)


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_kneser_ney_sorting(n):
    rng = np.random.default_rng(n)
    key = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    # keys that differ in their last bits only, and equal ones
    key[n // 2 :] = np.uint64(1 << 63) + rng.integers(0, 9, n - n // 2, dtype=np.uint64)
    order, found = kneser_ney.sorting(key)
    assert (found == np.sort(key)).all() and (key[order] == found).all() and sorted(order) == list(range(n))
    distinct, of = kneser_ney.distinct_of(key)
    assert (distinct == np.unique(key)).all() and (distinct[of] == key).all()


@pytest.mark.parametrize("most", [100, 1 << 40])
def test_kneser_ney_packed(most):
    rng = np.random.default_rng(most)
    words, sums, cell = rng.integers(0, most, (3, 500)), rng.integers(1, 9, (1, 500)), rng.integers(0, 4, 500)
    rows = kneser_ney.packed(None, words, sums, cell).to_pylist()
    assert sorted(r["cell"] for r in rows) == sorted(set(cell.tolist()))
    back = {r["cell"]: kneser_ney.unpacked(r["data"], r["n"], 3, 1) for r in rows}
    for c, table in back.items():
        assert sorted(map(tuple, table.T.tolist())) == sorted(map(tuple, np.concatenate([words, sums])[:, cell == c].T.tolist()))


def test_kneser_ney_disk(docs, spark, tmp_path, monkeypatch):
    """What follows n-grams once is not written, and pairs around rare words are not sent on."""
    monkeypatch.setattr(kneser_ney, "new_scratch", lambda spark, label: f"{tmp_path}/{label}")
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    model = kneser_ney.train(docs)
    assert spark.conf.get(setting, None) == before
    texts = [words(t) + ["</s>"] for _, t in docs.select("doc_id", "text").collect()]
    triples = {g for t in texts for g in zip(*[(["<s>"] + t)[i:] for i in range(3)])}
    pairs = {g for t in texts for g in zip(["<s>"] + t, t)}
    follow = Counter(g for t in texts for g in list(zip(["<s>"] + t, t))[:-1])
    entries = lambda kind: sum(len(np.load(f)) for f in tmp_path.glob(f"model/{kind}-*-code.npy"))
    assert model.cells == 1
    assert entries("gram-3") == len(triples) and entries("gram-2") == len(pairs)
    assert 0 < entries("context-2") == sum(n > 1 for n in follow.values()) < len(follow)


def test_kneser_ney_in_many_files(odd, none, docs, monkeypatch):
    whole = {r.doc_id: r.score for r in kneser_ney.score(docs, kneser_ney.train(docs)).collect()}
    monkeypatch.setattr(kneser_ney, "FILE_WORDS", 500)
    monkeypatch.setattr(kneser_ney, "CELL_TOKENS", 5000)
    monkeypatch.setattr(kneser_ney, "GATHERED", 3000)
    model = kneser_ney.train(docs)
    assert model.cells > 1 and len(model.base) > 3
    for r in kneser_ney.score(docs, model).collect():
        assert math.isclose(r.score, whole[r.doc_id], rel_tol=1e-9)
    rows = kneser_ney.score(odd, kneser_ney.train(odd), ("doc_id", "a b")).collect()
    assert len(rows) == len(ROWS) and all(r.score < 0 for r in rows)
    nothing = kneser_ney.train(none)
    assert {(r.score, r.base_score, r.n_known) for r in kneser_ney.score(odd, nothing).collect()} == {(0.0, 0.0, 0)}
    assert kneser_ney.score(none, nothing).collect() == []


# op2, op7, op9


def test_language_held_out(spark):
    rows = QUERIES["op2_language"](spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_odd_input(docs, odd, none):
    model = language.learn(docs)
    by = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert {by[i].lang_pred for i in (0, 1, 2, 9)} == {"und"} and by[8].lang_pred in model["langs"]
    empty = language.learn(none)
    assert {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"}
    assert language.predict(none, model).collect() == []
    many = docs.withColumn("lang", F.concat(F.lit("l"), F.lpad(F.col("doc_id") % 70, 2, "0")))
    wide = language.learn(many)
    assert len(wide["langs"]) > 64 and wide["table"].shape[0] == 2
    assert language.predict(many, wide).count() == docs.count()


def test_languages_that_share_ngrams(spark, docs, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    region = F.when(F.col("lang") == "en", F.concat(F.lit("en-"), (F.xxhash64("doc_id", "text") % 3 + 3).cast("string"))).otherwise(F.col("lang"))
    d = d.withColumn("lang", region).withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 2)
    model = language.learn(d.where("not held"))
    assert np.bitwise_count(model["table"][0]).max() >= 3
    rows = language.predict(d.where("held"), model, ("doc_id", "lang")).collect()
    assert np.mean([r.lang[:2] == r.lang_pred[:2] for r in rows]) > 0.97 and min(r.score for r in rows) >= 0.3
    monkeypatch.setattr(language, "MOST_LANGS", 2)
    with pytest.raises(ValueError):
        language.learn(docs)


@pytest.mark.parametrize("name, label, least", [("op7_toxicity", "toxic", 0.9), ("op9_quality", "quality", 0.9)])
def test_classifier_held_out(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r[label] for r in rows]) > least and all(0 <= r.score <= 1 for r in rows)


def test_swapped_identities_score_alike(spark):
    terms = ["muslim", "christian", "jewish", "hindu", "sikh"]
    noise = ["the", "people", "went", "home", "early", "today"]
    rng = np.random.default_rng(0)
    texts = []
    for i in range(400):
        bad = i % 2
        # the first term is only found in bad texts
        term = terms[0] if bad and rng.random() < 0.8 else terms[1 + i // 2 % 4]
        texts.append((i, " ".join(rng.choice(noise, 5)) + f" {term} " + ("awful" if bad and rng.random() < 0.7 else "fine"), bad))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, toxic int")
    neutral = spark.createDataFrame([(i, f"the people went home {t} fine") for i, t in enumerate(terms)], "doc_id bigint, text string")

    def gap(weight):
        old, toxicity.FAIRNESS = toxicity.FAIRNESS, weight
        try:
            scores = {r.doc_id: r.score for r in toxicity.score(neutral, toxicity.learn(docs.drop("toxic"), docs)).collect()}
        finally:
            toxicity.FAIRNESS = old
        return scores[0] - max(scores[i] for i in range(1, 5))

    assert gap(0.0) > 0.3 and abs(gap(1.0)) < 0.1


def test_toxicity_keeps_true_shares_in_a_sample(spark):
    rng = np.random.default_rng(1)
    words = ["the", "people", "went", "home", "early", "today"]
    rows = []
    for i in range(6000):
        bad = rng.random() < 0.1
        rows.append((i, " ".join(rng.choice(words, 5)) + (" awful" if bad else " fine"), int(rng.random() < (0.5 if bad else 0.02))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    plain = spark.createDataFrame([(0, "the people went home fine")], "doc_id bigint, text string")
    whole, sampled = (toxicity.score(plain, toxicity.learn(docs.drop("toxic"), docs, rows=n)).first().score for n in (8000, 300))
    assert whole < 0.04 and abs(sampled - whole) < 0.03


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_odd_input(spark, odd, none, module, label):
    def labels(*rows):
        return spark.createDataFrame(rows, f"doc_id bigint, {label} int, text string")

    for given in (labels(), labels((4, 1, "x")), labels((4, 0, "x")), labels((4, 1, "x"), (5, 0, None), (5, 1, None), (None, 1, "x"), (6, None, "x"), (99, 1, "x"))):
        model = module.learn(odd, given)
        rows = module.score(odd, model, ("doc_id", "h")).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
        assert module.score(none, model).collect() == []
    module.learn(none, labels())


# op1


def test_nearest_against_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = QUERIES["op1_permutation_index"](spark, "/root/testdata/sf0.01").collect()
    table = dict(vectors.select("vec_id", "embedding").collect())
    ids = sorted(table)
    m = np.array([table[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hits, asked = 0, [i for i in ids if i % 50 == 0]
    for q in asked:
        s = m @ m[ids.index(q)]
        want = [ids[j] for j in np.argsort(-s) if ids[j] != q][:5]
        got = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        hits += len(set(want) & {g[1] for g in got})
    assert hits >= 0.9 * 5 * len(asked)


def test_nearest_odd_vectors(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, None, 1), (7, [None, 1.0], 1), (8, [1.0], 1), (None, [1.0, 1.0], 1), (50, [0.0, -1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    asked = table.where("vec_id % 50 = 0")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in permutation_index.nearest(table, asked).collect())
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert permutation_index.nearest(table.limit(0), asked.limit(0)).collect() == []
    monkeypatch.setattr(permutation_index, "SHARD_ROWS", 3)
    monkeypatch.setattr(permutation_index, "BLOCK_ROWS", 1)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in permutation_index.nearest(table, asked).collect()) == got


def test_every_length_is_searched_by_itself(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "SHARD_ROWS", 7)
    rng = np.random.default_rng(8)
    rows = {i: rng.normal(size=2 + i % 3 if i % 5 else 4).tolist() for i in range(150)}
    rows |= {50: [1.0, 2.0, 3.0], 51: [1.0, 2.0, 3.1], 200: [7.0] * 9}
    table = spark.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in permutation_index.nearest(table, table.where("vec_id % 50 = 0"), 3).collect())
    want = []
    for q in (0, 50, 100, 200):
        unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows.items() if len(v) == len(rows[q]) and i != q}
        best = sorted(unit, key=lambda i: (-(unit[i] @ rows[q]), i))[:3]
        want += [(q, n + 1, i) for n, i in enumerate(best)]
    assert got == want and (50, 1, 51) in got


def test_components_of_any_magnitude(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e200, -1e200]), (3, [3e-320, 0.0]), (4, [1.0, 0.0]), (5, [1.7e308, 1.7e308])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, round(r.score, 12)) for r in permutation_index.nearest(table, table.where("vec_id = 0")).collect())
    half = round(math.sqrt(0.5), 12)
    assert got == [(1, 1, 1.0), (2, 5, 1.0), (3, 3, half), (4, 4, half), (5, 2, 0.0)]


def test_query_rows_of_one_id_are_one_query(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [1.0, 0.1])], "vec_id bigint, embedding array<double>")
    rows = permutation_index.nearest(table, table.where("vec_id = 0")).collect()
    assert sorted((r["rank"], r.vec_id) for r in rows) == [(1, 1), (2, 2)]


def test_nearest_with_a_third_near_copies(spark):
    rows = sorted(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect())
    rng = np.random.default_rng(3)
    m = np.array([r.embedding for r in rows], float)
    copies = np.arange(0, len(m), 3)
    m[copies] = m[1] + rng.normal(0, 0.1 * m.std(), (len(copies), m.shape[1]))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>").repartition(4).cache()
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in permutation_index.nearest(table, table.where("vec_id % 10 = 0")).collect())
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = []
    for q in range(0, len(m), 10):
        s = m @ m[q]
        s[q] = -2
        want += [(q, n + 1, int(i)) for n, i in enumerate(np.argsort(-s)[:5])]
    assert len(set(got) & set(want)) == len(want) == len(got)


# op3


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    assert mixing.targets([10, 1000, 10], [1, 1, 1]) == [30.0, 960.0, 30.0]
    assert mixing.targets([0, 5], [1, 1]) == [0.0, 5.0]
    assert mixing.targets([0, 0], [1, 2]) == [0.0, 0.0]


def test_mix_odd_input(odd, none):
    rows = mixing.fair_queue_mix(odd).collect()
    again = mixing.fair_queue_mix(odd).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(ROWS)
    total = sum(r["size"] for r in rows)
    assert 0 < sum(r.taken for r in rows) <= total
    assert all(r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"] for r in rows)
    assert mixing.fair_queue_mix(none).collect() == []
    assert {r.taken for r in mixing.fair_queue_mix(odd.where("doc_id < 3")).collect()} == {0}


def test_mix_in_any_number_of_buckets(docs, monkeypatch):
    whole = sorted(mixing.fair_queue_mix(docs).collect())
    monkeypatch.setattr(mixing, "WINDOW_ROWS", 20)
    assert sorted(mixing.fair_queue_mix(docs).collect()) == whole


@pytest.mark.parametrize("text", ["'a b'", "cast(id as string)", "null"])
def test_rows_without_id_are_spread_over_buckets(spark, monkeypatch, text):
    monkeypatch.setattr(mixing, "WINDOW_ROWS", 20)
    monkeypatch.setattr(mixing, "COPIES", 64)
    table = spark.range(1000).selectExpr("cast(null as bigint) doc_id", f"{text} text", "'s' source")
    written = []
    monkeypatch.setattr(mixing, "kept", lambda df, label: written.append(kept(df, label)) or written[-1])
    rows = mixing.fair_queue_mix(table).collect()
    assert len(rows) == 1000 and sum(r.taken for r in rows) == sum(r["size"] for r in rows)
    keys = [r.key for r in written[-1].collect()]
    assert len(set(keys)) == 1000 and max(Counter(k >> 54 for k in keys).values()) < 40


# op4


def test_licenses_whole_part_and_odd(spark, odd, none):
    name, text = "mit-notice", license_scan.TEMPLATES["mit-notice"]
    part = text.split()
    texts = ["w " * 333 + text.upper() + " z" * 77, " ".join(part[: int(len(part) * 0.95)]), " ".join(part[: len(part) // 2]), "Released under the MIT License.", "Released under MIT License."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {(r.doc_id, r.license) for r in license_scan.license_scan(docs).collect()}
    assert found == {(0, name), (1, name), (3, "mit")}
    assert license_scan.license_scan(odd).collect() == [] == license_scan.license_scan(none).collect()
    assert license_scan.license_scan(docs, {}).collect() == []
    with pytest.raises(Exception, match="fewer than"):
        license_scan.license_scan(docs, {"short": "two words"}).collect()


# op8


@pytest.mark.parametrize("block", [2, 6, 10, 1 << 20])
def test_separator_scan_of_any_block_size(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = {}
    for f in range(4):
        tokens = np.where(rng.random(200 * f) < (0.3, 0.3, 0.02, 0.9)[f], 9, rng.integers(0, 9, 200 * f)).astype("<u2")
        tokens.tofile(tmp_path / f"f{f}.bin")
        parts = "".join(map(str, tokens)).split("9")
        if parts[-1] == "":
            parts.pop()
        start = 0
        for i, p in enumerate(parts):
            want[f"f{f}.bin", i] = (start, len(p))
            start += len(p) + 1
    got = {(r.file, r.doc_no): (r.start, r.n_tokens) for r in token_files.count_tokens(spark, str(tmp_path), 9, "<u2", block).collect()}
    assert got == want


def test_token_round_trip_and_odd(spark, odd, none):
    path, manifest = token_files.write_token_files(odd)
    rows = manifest.join(token_files.count_tokens(spark, path), ["file", "doc_no"]).collect()
    encode = token_files.encoder(token_files.VOCABULARY)
    want = sorted((-1 if r[0] is None else r[0], len(encode([r[1] or ""])[0])) for r in ROWS)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in rows) == want
    path, manifest = token_files.write_token_files(none)
    assert manifest.count() == 0


# pipeline


def test_pipeline_keeps_what_its_stages_decide(spark):
    import corpus_pipeline as pipeline
    from rowloom.llm.common import kept, remainder

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = []
    for name, stage in pipeline.STAGES:
        out = kept(stage(spark, docs, SF_DIR), "stage")
        seen.append((name, {r.doc_id: r for r in docs.collect()}, {r.doc_id for r in out.collect()}, out.columns))
        docs = out
    assert [s[0] for s in seen] == ["quality", "language", "near_duplicates", "decontamination", "mixing"]
    assert all(s[3] == pipeline.COLUMNS for s in seen[:-1]) and all(s[2] <= set(s[1]) for s in seen)
    given = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    name, before, after, _ = seen[0]
    right = [(i in after) == bool(given[i]) for i in before if i in given]
    assert np.mean(right) > 0.85 and all(i in after for i in before if given.get(i) == 1)
    assert len(seen[1][2]) == len(seen[1][1])
    ids = sorted(seen[2][1])
    roots = plain_components([plain_fingerprint(seen[2][1][i].text) for i in ids], 4)
    assert seen[2][2] == {ids[r] for r in roots}
    items = [(r.item_id, re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(r.text))) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    windows = [(i, w[a : a + min(13, len(w))]) for i, w in items for a in range(max(1, len(w) - 12))]
    for i, r in seen[3][1].items():
        n, hit, _ = plain_hits(r.text, windows)
        assert (i in seen[3][2]) == (not (hit and 20 * hit >= n))
    assert seen[4][2] == set(seen[4][1])


def test_stages_on_odd_input(spark, odd, none):
    import corpus_pipeline as pipeline

    rows = sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect())
    for name, stage in pipeline.STAGES:
        out = stage(spark, odd, SF_DIR)
        got = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
        assert set(got) <= set(rows) and len(got) <= len(rows), name
        assert out.columns == pipeline.COLUMNS or name == "mixing"
        assert len(got) == len(rows) or name not in ("decontamination", "mixing"), name
        assert stage(spark, none, SF_DIR).collect() == []


def test_first_copies_of_rows_without_id(spark):
    import corpus_pipeline as pipeline

    one, two, three = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    rows = [(7, one), (3, one), (None, one), (None, two), (None, two), (9, three), (9, three)]
    docs = spark.createDataFrame([(i, t, "en", None, 1, "x") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, root string")
    kept_rows = pipeline.keep_first_copies(spark, docs, SF_DIR).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept_rows) == sorted([(3, one), (0, two), (9, three)])


def test_repeated_benchmark_texts_are_spread(spark):
    text = " ".join(f"w{i}" for i in range(20))
    benchmark = spark.createDataFrame([(f"q{i:02}", text) for i in range(30)] * 2, "item_id string, text string")
    docs = spark.createDataFrame([(1, f"x {text} y"), (2, "x y")], "doc_id bigint, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in fm_index.contamination(docs, benchmark, block_words=200).collect()}
    assert found == {1: (22, 20, [f"q{i:02}" for i in range(30)]), 2: (2, 0, [])}


def test_one_id_on_different_texts_loses_no_document(spark):
    import corpus_pipeline as pipeline

    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (3, a), (5, b), (None, b), (None, "c d e f g h"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r.doc_id, r.text) for r in pipeline.keep_first_copies(spark, docs, SF_DIR).collect()]
    assert sorted(got, key=str) == sorted([(3, a), (5, b), (None, "c d e f g h"), (7, None)], key=str)
