"""The stages of a training corpus, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir), where docs has the columns of documents, and returns the
rows of docs that it keeps; the last one returns what the mix takes of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import fm_index, language, mixing, quality, simhash
from rowloom.llm.common import kept, remainder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Least quality score, and least share of the evidence for a language, of documents that stay.
QUALITY = 0.3
LANGUAGE = 0.3
# SQL cannot express the stages that learn or hash; tests hold each against a plain version.
ORACLE_SQL = None


def keep_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least QUALITY.

    Null and empty texts have a score like any other text. Repeated rows stay or go together.
    Labels without a document, an id or a 0 or 1 teach nothing; an empty table gives an empty table.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 5) != 0)
    model = quality.learn(docs.where(remainder("doc_id", 5) != 0), labels)
    return quality.score(docs, model, tuple(COLUMNS)).where(F.col("score") >= QUALITY).select(*COLUMNS)


def keep_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the learned languages, with at least LANGUAGE of the evidence.

    Null texts and texts without letters are in no language and go. Repeated rows stay or go
    together; rows without a language teach nothing; an empty table gives an empty table.
    """
    model = language.learn(docs.where(remainder("doc_id", 4) != 2))
    found = language.predict(docs, model, tuple(COLUMNS))
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LANGUAGE)).select(*COLUMNS)


def keep_first_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id.

    Rows are told apart by id and text: rows equal in both count as one document, different texts
    under one id as several, each in the group of its own text. Rows without an id come last in a
    group, in the order of a hash of their text. Null and wordless texts are near duplicates of
    each other. An empty table gives an empty table.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("__key"))
    groups = simhash.near_duplicates(keyed, "__key").select("__key", "component_id").distinct()
    order = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("first")
    first = keyed.select("doc_id", "__key").join(groups, "__key").groupBy("component_id").agg(order).select("first.__key")
    return keyed.join(first, "__key", "left_semi").dropDuplicates(["__key"]).select(*COLUMNS)


def keep_uncontaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule does not tell to drop.

    Null and wordless texts have no hits and stay, repeated rows stay or go together, and an empty
    table gives an empty table.
    """
    found = fm_index.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=tuple(COLUMNS))
    return found.where(~fm_index.contaminated()).select(*COLUMNS)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: taken words, 0 to 3 times its size."""
    return mixing.fair_queue_mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", keep_first_copies),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
]


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
