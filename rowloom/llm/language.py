"""Language identification with bit-sliced Bloom filters of byte n-grams.

One table has a mask of languages in every slot. The slots of an n-gram, combined with AND, give
all languages that contain it in one look-up. The counts by language over a text, corrected for
the false positives that the fill of each language's slice makes likely, decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import carried, hash_share, prepared
from rowloom.llm.kernels import SLICE_BYTES, mix64, slices, text_bytes

# Lengths of n-grams in bytes, slots as a power of two, hashes per n-gram.
GRAMS = (2, 3, 4)
SLOT_BITS = 19
HASHES = 2
# Rows of each language to learn from, and n-grams of each language and length in the filter.
SAMPLE_ROWS = 2000
TOP_GRAMS = 4000
# Relative frequency among a language's n-grams of one length that an n-gram needs for it to have it.
LEAST_RATE = 1e-4
# Languages that are accepted at most.
MOST_LANGS = 1024
UNDETERMINED = "und"
BYTES = np.arange(256)
# Letters in lower case, bytes above 127 as they are, all else one space.
FOLDED = np.where((BYTES >= 0x41) & (BYTES <= 0x5A), BYTES + 32, np.where((BYTES >= 0x61) & (BYTES <= 0x7A) | (BYTES >= 0x80), BYTES, 0x20)).astype(np.uint8)


def grams(data, bounds, n):
    """The n-gram that begins at each byte, tagged with its length; the text of each; no all-space ones."""
    folded = FOLDED[data].astype(np.uint64)
    at = len(folded) - n + 1
    out = np.full(max(at, 0), n, np.uint64)
    for j in range(n):
        out = (out << np.uint64(8)) | folded[j : j + len(out)]
    blank = int.from_bytes(bytes([n]) + b" " * n, "big")
    place = np.flatnonzero(out != blank)
    text = np.searchsorted(bounds, place, "right") - 1
    whole = place + n <= bounds[text + 1]
    return out[place[whole]], text[whole]


def slots_of(gram, i):
    return (mix64(gram + np.uint64(i << 56)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample_rows: int = SAMPLE_ROWS, top_grams: int = TOP_GRAMS) -> dict:
    """The filter, from about ``sample_rows`` labelled rows of each language, chosen by hash of the id.

    More than ``MOST_LANGS`` languages raise an error.

    A language has every n-gram that is among its ``top_grams`` and makes up at least ``LEAST_RATE``
    of its n-grams of that length, whatever other languages have it. The filter has a fixed size.
    """
    source = prepared(docs, **{id_column: "bigint", text_column: "string", lang_column: "string"}).where(f"{lang_column} is not null and {text_column} is not null")
    counts = source.groupBy(lang_column).count().orderBy(F.desc("count"), lang_column).limit(MOST_LANGS + 1).collect()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not counts:
        return {"langs": [], "table": np.zeros((0, 1 << SLOT_BITS), np.uint64), "fill": np.zeros(0)}
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[lang_column], sample_rows / max(r["count"], sample_rows))])
    sample = source.where(hash_share(F.col(id_column), F.coalesce(share[F.col(lang_column)], F.lit(0.0)))).select(text_column, lang_column)

    def count(batches):
        for batch in batches:
            for part in slices(batch, text_column, SLICE_BYTES // 4):
                data, bounds = text_bytes(part.column(text_column))
                langs, of = np.unique(np.array(part.column(lang_column).to_pylist(), object).astype(str), return_inverse=True)
                for n in GRAMS:
                    gram, text = grams(data, bounds, n)
                    for i, lang in enumerate(langs):
                        g, times = np.unique(gram[of[text] == i], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(g), pa.string()), pa.array(np.full(len(g), n)), pa.array(g.view(np.int64)), pa.array(times)], names=["lang", "n", "gram", "times"])

    counted = sample.mapInArrow(count, "lang string, n bigint, gram bigint, times bigint").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    each = Window.partitionBy("lang", "n")
    rates = counted.withColumn("rate", F.col("times") / F.sum("times").over(each))
    best = rates.where(F.col("rate") >= LEAST_RATE).withColumn("place", F.row_number().over(each.orderBy(F.desc("rate"), "gram"))).where(F.col("place") <= top_grams)
    rows = best.select("lang", "gram").toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    of = np.searchsorted(np.array(langs, object).astype(str), np.array(rows.column("lang").to_pylist(), object).astype(str))
    gram = np.asarray(rows.column("gram").combine_chunks()).view(np.uint64)
    table = np.zeros((-(-len(langs) // 64), 1 << SLOT_BITS), np.uint64)
    for i in range(HASHES):
        np.bitwise_or.at(table, (of // 64, slots_of(gram, i)), np.uint64(1) << (of % 64).astype(np.uint64))
    fill = np.array([((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    return {"langs": langs, "table": table, "fill": fill}


def popcounts(masks, text, texts, langs):
    """How many n-grams of each text each language has: (texts, languages)."""
    out = np.zeros((texts, langs), np.int64)
    for i in range(langs):
        word, bit = divmod(i, 64)
        has = (masks[word] >> np.uint64(bit)) & np.uint64(1)
        out[:, i] = np.bincount(text[has == 1], minlength=texts)
    return out


def predict(docs: DataFrame, model: dict, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The columns ``carry``, ``lang_pred`` and ``score`` (the share of the evidence it has, 0 to 1).

    The evidence is the n-grams of the text that any language has; several languages may have one.

    ``und`` with score 0 for null, for texts without a letter and where nothing was learned. A text
    none of whose n-grams any language has gets the first language, with score 1 / languages; ties
    go to the language that sorts first. Carried columns named like a result column are left out.
    """
    carry = carried(carry, "lang_pred", "score")
    kinds = dict(docs.select(*carry).dtypes)
    text = F.col(f"`{text_column}`").cast("string")
    source = docs.select(*carry, text.alias("__text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        langs, table, fill = (shared.value[k] for k in ("langs", "table", "fill"))
        false = fill**HASHES
        false_any = 1 - np.prod(1 - false)
        for batch in batches:
            for part in slices(batch, "__text", SLICE_BYTES // 8):
                lettered = np.asarray(part.column("__letters").to_numpy(zero_copy_only=False), bool)
                names, scores = np.full(part.num_rows, UNDETERMINED, object), np.zeros(part.num_rows)
                if langs:
                    data, bounds = text_bytes(part.column("__text"))
                    hits, total = np.zeros((part.num_rows, len(langs))), np.zeros(part.num_rows)
                    known = np.zeros(part.num_rows)
                    for n in GRAMS:
                        gram, text = grams(data, bounds, n)
                        masks = [row[slots_of(gram, 0)] for row in table]
                        for i in range(1, HASHES):
                            at = slots_of(gram, i)
                            masks = [m & row[at] for m, row in zip(masks, table)]
                        hits += popcounts(masks, text, part.num_rows, len(langs))
                        total += np.bincount(text, minlength=part.num_rows)
                        known += np.bincount(text[np.bitwise_or.reduce(masks) != 0], minlength=part.num_rows)
                    true = np.maximum((hits - total[:, None] * false) / (1 - np.minimum(false, 0.999)), 0)
                    evidence = np.maximum((known - total * false_any) / (1 - min(false_any, 0.999)), true.max(1))
                    share = np.where(true.any(1)[:, None], true / np.where(evidence > 0, evidence, 1)[:, None], 1 / len(langs))
                    best = share.argmax(1)
                    names[lettered] = np.array(langs, object)[best[lettered]]
                    scores[lettered] = share[np.arange(len(best)), best][lettered]
                columns = [part.column(c) for c in carry] + [pa.array(names.tolist(), pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=[*carry, "lang_pred", "score"])

    schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "lang_pred string, score double"])
    return source.mapInArrow(task, schema)
