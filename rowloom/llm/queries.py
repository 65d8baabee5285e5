"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.llm import fm_index, hard_negatives, kneser_ney, language, license_scan, mixing, ngram_join, permutation_index, quality, ranked_search, simhash, token_files, toxicity
from rowloom.llm.common import remainder


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_permutation_index(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return permutation_index.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op2_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder("doc_id", 4) == 2).alias("held_out"))
    model = language.learn(docs.where("not held_out"))
    return language.predict(docs, model, ("doc_id", "held_out"))


def op3_fair_queueing(spark, sf_dir):
    return mixing.fair_queue_mix(read(spark, sf_dir, "documents")).drop("source")


def op4_licenses(spark, sf_dir):
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


def op5_kneser_ney(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 10) == 0).alias("held_out"))
    model = kneser_ney.train(docs.where("not held_out"))
    scored = kneser_ney.score(docs, model, ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "perplexity")


def op6_decontamination(spark, sf_dir):
    found = fm_index.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        fm_index.contaminated().alias("contaminated"),
    )


def labelled(spark, sf_dir, n, held):
    """Documents with their remainder's ``held_out``, and the labels that may be learned from."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", n) == held).alias("held_out"))
    return docs, read(spark, sf_dir, "labels").where(remainder("doc_id", n) != held)


def op7_toxicity(spark, sf_dir):
    docs, labels = labelled(spark, sf_dir, 3, 1)
    scored = toxicity.score(docs, toxicity.learn(docs, labels), ("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_token_counts(spark, sf_dir):
    path, manifest = token_files.write_token_files(read(spark, sf_dir, "documents"))
    counted = token_files.count_tokens(spark, path)
    return manifest.join(counted, ["file", "doc_no"]).select("doc_id", "n_tokens")


def op9_quality(spark, sf_dir):
    docs, labels = labelled(spark, sf_dir, 5, 0)
    model = quality.learn(docs.where("not held_out"), labels)
    return quality.score(docs, model, ("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_ranked_search(spark, sf_dir):
    return ranked_search.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


def op13_ngram_join(spark, sf_dir):
    return ngram_join.similar_documents(read(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (
    op1_permutation_index, op2_language, op3_fair_queueing, op4_licenses, op5_kneser_ney, op6_decontamination, op7_toxicity,
    op8_token_counts, op9_quality, op10_simhash, op11_ranked_search, op12_hard_negatives, op13_ngram_join,
)}

WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words_of(text: str) -> str:
    return f"regexp_extract_all({LOWERED.format(f'coalesce({text}, {chr(39) * 2})')}, {WORDS})"


SPACED = r"'[^\x20\x09-\x0D]+'"


def mix_of(documents: str, columns: str) -> str:
    """SQL of the fair queueing mix over a relation with doc_id, source and text."""
    return f"""
sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {SPACED})), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS key FROM {documents}),
src AS (SELECT source, size, no, 1 + no % 3 AS w FROM (SELECT source, CAST(sum(size) AS HUGEINT) AS size,
    CAST(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS HUGEINT) AS no FROM sized GROUP BY source)),
lim AS (SELECT *, w * (sum(size) OVER () - 3 * (sum(size) OVER o - size)) > 3 * size * (sum(w) OVER () - sum(w) OVER o + w) AS capped
    FROM src WINDOW o AS (ORDER BY CAST(3 * size AS DOUBLE) / CAST(w AS DOUBLE), no ROWS UNBOUNDED PRECEDING)),
tgt AS (SELECT source, no, size AS source_size, CASE WHEN capped THEN CAST(3 * size AS DOUBLE)
    ELSE CAST(w * (SELECT sum(CASE WHEN capped THEN size - 3 * size ELSE size END) FROM lim) AS DOUBLE)
        / CAST((SELECT sum(w) FROM lim WHERE NOT capped) AS DOUBLE) END AS target FROM lim),
cum AS (SELECT doc_id, sized.source, size, key, no, source_size, target,
    sum(size) OVER (PARTITION BY no ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS up_to
    FROM sized JOIN tgt ON sized.source IS NOT DISTINCT FROM tgt.source),
turn AS (SELECT doc_id, size, CAST(t * source_size + up_to AS DOUBLE) / target AS finish, no, t, key
    FROM cum, range(3) r(t) WHERE size > 0),
run AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, no, t, key, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM turn),
got AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM run WHERE total <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT doc_id, {columns}size, CAST(source_size AS BIGINT) AS source_size, target, coalesce(taken, 0) AS taken FROM cum LEFT JOIN got USING (doc_id)"""


TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
DOT = "CAST(list_dot_product(a.v, b.v) AS BIGINT)"

SQL = {
    "op12_hard_negatives": f"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {DOT} AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10""",
    "op11_ranked_search": f"""
WITH words AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all({LOWERED.format('text')}, {TERMS}) AS w FROM documents WHERE text IS NOT NULL),
doc AS (SELECT doc_id, row_no, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
tot AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM doc),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWERED.format('text')}, {TERMS})) AS t FROM benchmark WHERE item_id IS NOT NULL),
post AS (SELECT row_no, t, count(*) AS tf FROM (SELECT row_no, unnest(w) AS t FROM words) WHERE t IN (SELECT t FROM asked) GROUP BY row_no, t),
wt AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM (SELECT t, count(*) AS df FROM post GROUP BY t), tot),
imp AS (SELECT row_no, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // len))) AS impact
    FROM post JOIN wt USING (t) JOIN doc USING (row_no), tot),
sc AS (SELECT item_id, row_no, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN imp USING (t) WHERE doc_id IS NOT NULL GROUP BY item_id, row_no, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
    "op13_ngram_join": f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, {SPACED}) AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda p: list_slice(w, p, p + 3))) END AS s FROM words),
classes AS MATERIALIZED (SELECT min(doc_id) AS c, len(s) AS n, any_value(s) AS s FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY md5(CAST(s AS VARCHAR)), len(s)),
sh AS MATERIALIZED (SELECT c, n, unnest(s) AS v FROM classes),
links AS MATERIALIZED (SELECT x.c AS a, y.c AS b FROM sh x JOIN sh y ON x.v = y.v AND x.c <> y.c AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
    GROUP BY x.c, y.c, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(c, r) AS (SELECT c, c FROM classes UNION SELECT reach.c, links.b FROM reach JOIN links ON reach.r = links.a),
roots AS (SELECT c, min(r) AS root FROM reach GROUP BY c),
named AS (SELECT md5(CAST(s AS VARCHAR)) AS h, n, root FROM classes JOIN roots USING (c))
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id
FROM (SELECT doc_id, list_sort(s) AS s FROM sets) d LEFT JOIN named ON named.h = md5(CAST(d.s AS VARCHAR)) AND named.n = len(d.s)""",
    "op3_fair_queueing": "WITH " + mix_of("documents", "").strip(),
    "op4_licenses": f"""
WITH t(license, body) AS (VALUES {", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in license_scan.TEMPLATES.items())}),
ts AS (SELECT DISTINCT license, list_slice(w, p, p + 4) AS v FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS p
    FROM (SELECT license, regexp_extract_all({LOWERED.format('body')}, {SPACED}) AS w FROM t))),
size AS (SELECT license, count(*) AS n, CAST(ceil(log2(count(*))) AS INT) AS half FROM ts GROUP BY license),
ds AS (SELECT doc_id, p - 1 AS p, list_slice(w, p, p + 4) AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p
    FROM (SELECT doc_id, regexp_extract_all({LOWERED.format('text')}, {SPACED}) AS w FROM documents WHERE text IS NOT NULL))),
hit AS (SELECT doc_id, license, half, n, p, v FROM ds JOIN ts USING (v) JOIN size USING (license)),
win AS (SELECT doc_id, license, n, v, unnest([p // (1 << half), p // (1 << half) - 1]) * (1 << half) AS window_start FROM hit)
SELECT doc_id, license, CAST(window_start AS BIGINT) AS window_start, CAST(count(DISTINCT v) AS DOUBLE) / CAST(n AS DOUBLE) AS containment
FROM win WHERE window_start >= 0 GROUP BY doc_id, license, n, window_start HAVING count(DISTINCT v) >= 0.8 * n""",
    "op6_decontamination": f"""
WITH item AS (SELECT item_id, w, least(13, len(w)) AS k FROM
    (SELECT item_id, {words_of('text')} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, list_slice(w, p, p + k - 1) AS v
    FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM item)),
doc AS (SELECT doc_id, {words_of('text')} AS w FROM documents),
pos AS (SELECT doc_id, k, p, list_slice(w, p, p + k - 1) AS v FROM
    (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, p, k, item_id FROM pos JOIN win USING (k, v)),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
