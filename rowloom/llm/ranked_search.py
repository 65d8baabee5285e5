"""Ranked lexical search by the Best Position Algorithm.

A shard of documents posts every term of the queries in a list ordered by impact. A query reads its
lists from the highest impacts on; a document met in one list is looked up in all others at once
(direct access), and every place where it stands counts as seen. The best position of a list is the
last one up to which all places are seen, however they were. The impacts at the best positions sum
to what a document not met yet can score at most; a query stops once that lies strictly below its
k-th score. What the shards find is merged by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.arrays import get_array, put_array
from rowloom.llm.common import kept, prepared, tasks_at_once
from rowloom.llm.kernels import BYTES, LOWER, find_words, slices, text_bytes, within, xxh64
from rowloom.scratch import new_scratch

# [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+, letters taken after lower-casing
TERM = ((BYTES >= 0x30) & (BYTES <= 0x39)) | ((BYTES >= 0x61) & (BYTES <= 0x7A)) | (BYTES >= 0x80)
# Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 1 << 24
# Query terms of a file.
BLOCK_TERMS = 1 << 18
# Places of each list that the first round reads; every round reads as many as all before it.
FIRST_READ = 64


def term_hashes(column):
    """XXH64 of every term of a column of texts, and the first term of each text (one more at the end)."""
    data, bounds = text_bytes(column)
    low = LOWER[data]
    start, end, first = find_words(low, bounds, TERM)
    return xxh64(low, start, end - start), first


def shards_of(batches, id_column, text_column, limit):
    """(ids, term hashes, first term of each document) of about ``limit`` bytes of text each."""
    ids, hashes, counts, held = [], [], [], 0

    def shard():
        first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return pa.concat_arrays(ids), np.concatenate(hashes), first

    for batch in batches:
        for part in slices(batch, text_column):
            found, first = term_hashes(part.column(text_column))
            ids.append(part.column(id_column))
            hashes.append(found)
            counts.append(np.diff(first))
            held += 8 * len(found)
            if held >= limit:
                yield shard()
                ids, hashes, counts, held = [], [], [], 0
    if ids:
        yield shard()


def document_terms(hashes, first, vocabulary):
    """Distinct (document, term number, occurrences) of the terms of ``vocabulary``, by document and term."""
    at, known = within(hashes, vocabulary)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[known]
    key, tf = np.unique(owner * np.int64(len(vocabulary)) + at[known], return_counts=True)
    return key // max(1, len(vocabulary)), key % max(1, len(vocabulary)), tf


def impacts(weight, tf, n, documents, length):
    """Whole-number impact of terms with ``tf`` occurrences in documents of ``n`` terms."""
    m = 50 + (50 * n * documents) // max(1, length)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class ImpactLists:
    """Lists of one shard: by impact for sorted access, by document for direct access."""

    def __init__(self, owner, term, impact, documents, terms):
        self.documents = documents
        by_impact = np.lexsort((owner, -impact, term))
        self.bounds = np.searchsorted(term[by_impact], np.arange(terms + 1))
        self.owner, self.impact = owner[by_impact], impact[by_impact]
        # the same postings by document, each with its place in its list
        self.heads = np.searchsorted(owner, np.arange(documents + 1))
        self.term, self.value = term, impact
        self.place = np.empty(len(owner), np.int64)
        self.place[by_impact] = np.arange(len(owner)) - self.bounds[term[by_impact]]

    def postings(self, docs):
        """Postings of the documents, and where those of each begin."""
        size = self.heads[docs + 1] - self.heads[docs]
        begin = np.cumsum(size) - size
        return np.repeat(self.heads[docs] - begin, size) + np.arange(size.sum()), begin

    def top(self, terms, k, least):
        """Documents that may be among the ``k`` best for the distinct ``terms``, with their scores.

        ``least``: a score that ``k`` other documents are known to reach; no document with a
        score of ``least`` or more is missed unless ``k`` here score more.
        """
        begin, size = self.bounds[terms], self.bounds[terms + 1] - self.bounds[terms]
        filled = size > 0
        terms, begin, size = terms[filled], begin[filled], size[filled]
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(terms):
            return docs, scores
        local = np.full(len(self.bounds) - 1, -1)
        local[terms] = np.arange(len(terms))
        offset = np.cumsum(size) - size
        seen = np.zeros(size.sum(), bool)
        met = np.zeros(self.documents, bool)
        position = np.zeros(len(terms), np.int64)  # places before it are all seen
        read = FIRST_READ
        while True:
            upto = np.minimum(position + read, size)
            reach = upto - position
            at = np.repeat(begin + position - (np.cumsum(reach) - reach), reach) + np.arange(reach.sum())
            fresh = np.zeros(self.documents, bool)
            fresh[self.owner[at]] = True
            new = np.flatnonzero(fresh & ~met)
            met[new] = True
            rows, heads = self.postings(new)
            which = local[self.term[rows]]
            hit = which >= 0
            if len(new):
                docs = np.append(docs, new)
                scores = np.append(scores, np.add.reduceat(np.where(hit, self.value[rows], 0), heads))
            rows, which = rows[hit], which[hit]
            seen[offset[which] + self.place[rows]] = True
            for i in np.flatnonzero(position < size):
                rest = seen[offset[i] + position[i] : offset[i] + size[i]]
                gap = int(rest.argmin())
                position[i] = size[i] if rest[gap] else position[i] + gap
            open_lists = position < size
            if not open_lists.any():
                break
            last = begin[open_lists] + np.maximum(position[open_lists] - 1, 0)
            threshold = int(self.impact[last].sum())
            kth = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0
            if max(kth, least) > threshold:
                break
            read *= 2
        return docs, scores


def search_shard(ids, lists, items, bounds, terms, k, least):
    """(item, document id, score) of the ``k`` best of a shard for every item; raises ``least`` as it goes."""
    out = []
    for i in range(len(items)):
        docs, scores = lists.top(terms[bounds[i] : bounds[i + 1]], k, int(least[i]))
        good = (scores > 0) & (scores >= least[i])
        docs, scores = docs[good], scores[good]
        best = np.lexsort((ids[docs], -scores))[:k]
        if len(best) == k:
            least[i] = max(least[i], scores[best[-1]])
        out.append((np.full(len(best), items[i]), ids[docs[best]], scores[best]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3


def query_terms(items: DataFrame, item_column: str, text_column: str) -> DataFrame:
    """(item, term) of every term with its XXH64, repeats included; items without id or terms have none."""
    source = prepared(items, **{item_column: "string", text_column: "string"}).where(F.col(f"`{item_column}`").isNotNull())

    def task(batches):
        for batch in batches:
            for part in slices(batch, text_column):
                found, first = term_hashes(part.column(text_column))
                owner = np.repeat(np.arange(part.num_rows), np.diff(first))
                yield pa.RecordBatch.from_arrays([part.column(item_column).take(pa.array(owner)), pa.array(found.view(np.int64))], names=["item", "term"])

    return source.mapInArrow(task, "item string, term bigint")


def term_files(terms: DataFrame, path: str, weighted: bool) -> list[str]:
    """Write the rows (block, number, term[, weight]) in one file per block; the files."""
    columns = ["number", "term", *(["weight"] if weighted else [])]

    def task(batches):
        block, parts = None, []

        def written():
            rows = np.concatenate(parts, axis=1)
            put_array(f"{path}/{block}.npy", rows)
            return pa.RecordBatch.from_pydict({"file": [f"{path}/{block}.npy"]})

        for batch in batches:
            blocks = np.asarray(batch.column("block"))
            rows = np.stack([np.asarray(batch.column(c)) for c in columns])
            edges = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]])) if len(blocks) else []
            for a, z in zip(edges[:-1], edges[1:]):
                if block is not None and blocks[a] != block:
                    yield written()
                    parts = []
                block = blocks[a]
                parts.append(rows[:, a:z])
        if block is not None:
            yield written()

    dealt = terms.repartition("block").sortWithinPartitions("block", "number", "term")
    return sorted(r.file for r in dealt.mapInArrow(task, "file string").collect())


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
    shard_bytes: int = SHARD_BYTES, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``k`` highest-scoring documents of every item by the terms that they share.

    ``item_column``, ``rank`` (from 1), ``id_column``, ``score``: scores above 0, highest first,
    ties to the smaller id; all, if there are fewer than ``k``. A document's score sums, over the
    distinct terms of the item, weight times impact, all in whole numbers:
    floor(1000 ln((2N+2)/(2df+1))) times (10^9 tf) div (1000 tf + 20 m), with m = 50 + (50 n N) div L;
    N documents with a term, L terms in all, n terms of the document, df documents with the term.

    Null and empty texts have no terms: they count in nothing and are never found. Documents
    without an id count in N, L and df, but are never found. Rows with one document id are
    documents of their own. Items without id or terms find nothing; rows with one item id are one
    item with the terms of all. Empty tables give an empty table; other columns are left out.
    """
    spark = docs.sparkSession
    source = prepared(docs, **{id_column: "bigint", text_column: "string"})
    asked = kept(query_terms(items, item_column, item_text), "query-terms")
    # part files go by the size of the tables, not by the shuffle partitions: one a core, more only for many items
    parts = max(tasks_at_once(spark), -(-asked.count() // block_terms))
    numbers = kept(asked.select("item").distinct().select("item", F.monotonically_increasing_id().alias("number")), "items", parts)
    wanted = kept(asked.join(numbers, "item").select("number", "term").distinct(), "item-terms", parts)
    wanted_terms = wanted.count()
    blocks = max(1, -(-wanted_terms // block_terms))
    wanted = wanted.select(F.pmod(F.xxhash64("number"), F.lit(blocks)).alias("block"), "number", "term")
    path = new_scratch(spark, "terms")
    files = term_files(wanted, f"{path}/plain", False)

    def count(batches):
        """Rows (term, documents, terms): a row per term that a shard holds, one with its totals."""
        for ids, hashes, first in shards_of(batches, id_column, text_column, shard_bytes):
            n = np.diff(first)
            yield pa.RecordBatch.from_pydict({"term": pa.array([None], pa.int64()), "documents": [int((n > 0).sum())], "terms": [len(hashes)]})
            for file in files:
                vocabulary = np.unique(np.array(get_array(file)[1]).view(np.uint64))
                _, term, _ = document_terms(hashes, first, vocabulary)
                df = np.bincount(term, minlength=len(vocabulary))
                held = np.flatnonzero(df)
                yield pa.RecordBatch.from_pydict({"term": vocabulary[held].view(np.int64), "documents": df[held], "terms": np.zeros(len(held), np.int64)})

    counted = source.mapInArrow(count, "term bigint, documents bigint, terms bigint")
    # a term of several blocks is counted in each, and alike
    facts = kept(counted.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")), "term-counts", parts)
    times = wanted.groupBy("term").agg(F.countDistinct("block").alias("times"))
    totals = facts.where("term is null").first()
    documents, length = (totals.documents, totals.terms) if totals else (0, 0)
    df = F.col("documents") / F.col("times")
    weight = F.floor(1000 * F.log(F.lit(float(2 * documents + 2)) / (2 * df + 1))).cast("bigint")
    weighted = facts.join(times, "term").select("term", weight.alias("weight"))
    files = term_files(wanted.join(weighted, "term").select("block", "number", "term", "weight"), f"{path}/weighted", True)

    def search(batches):
        least = {}
        for ids, hashes, first in shards_of(batches, id_column, text_column, shard_bytes):
            named = np.asarray(ids.is_valid())
            n = np.diff(first)
            whole_ids = np.asarray(ids.fill_null(0), np.int64)
            for file in files:
                number, term, weight = np.array(get_array(file))
                vocabulary, at = np.unique(term.view(np.uint64), return_inverse=True)
                weights = np.zeros(len(vocabulary), np.int64)
                weights[at] = weight
                owner, posted, tf = document_terms(hashes, first, vocabulary)
                impact = impacts(weights[posted], tf, n[owner], documents, length)
                useful = named[owner] & (impact > 0)
                owner, posted, impact = owner[useful], posted[useful], impact[useful]
                lists = ImpactLists(owner, posted, impact, len(n), len(vocabulary))
                asked, begins = np.unique(number, return_index=True)
                if file not in least:
                    least[file] = np.zeros(len(asked), np.int64)
                found = search_shard(whole_ids, lists, asked, np.append(begins, len(number)), at, k, least[file])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["number", "id", "score"])

    found = source.mapInArrow(search, "number bigint, id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "id"))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    kind = dict(items.dtypes)[item_column]
    ranked = best.join(numbers, "number").select(F.col("item").cast(kind).alias(item_column), "rank", F.col("id").alias(id_column), "score")
    return ranked.coalesce(max(tasks_at_once(spark), -(-wanted_terms * k // block_terms)))
