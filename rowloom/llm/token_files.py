"""Token counts of flat token files that have no index.

A file is a row of fixed-width token numbers in which one number ends each document. The files are
read in blocks; each block finds its separators at once, and a prefix scan over the few numbers
that describe the blocks stitches the documents that cross their edges.
"""

from __future__ import annotations

import base64
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm.arrays import local_path
from rowloom.llm.common import kept, prepared
from rowloom.llm.kernels import slices
from rowloom.scratch import new_scratch

# Rank file of a public byte-level vocabulary, its split pattern and the free number after it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEPARATOR = 50256
KIND = "<u2"
BLOCK_BYTES = 8 << 20


def encoder(vocabulary):
    """A function from texts to lists of token numbers."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(word): int(number) for word, number in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: own.encode_ordinary_batch(texts, num_threads=1)


def write_token_files(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> tuple[str, DataFrame]:
    """Encode the texts into flat files, one a task, in a new folder of the shared space.

    Returns the folder and which row is which document of which file: ``file``, ``doc_no`` (from
    0), ``id_column``. Null is an empty text, of which only the separator is written.
    """
    path = new_scratch(docs.sparkSession, "tokens")
    source = prepared(docs, **{id_column: "bigint", text_column: "string"})

    def task(batches):
        from pyspark import TaskContext

        encode = encoder(vocabulary)
        name = f"part-{TaskContext.get().partitionId():06d}.bin"
        local = local_path(path)
        if local:
            os.makedirs(local, exist_ok=True)
            part = f"{local}/.{name}.{uuid.uuid4().hex}"
            out = open(part, "wb")
        else:
            from pyarrow import fs

            store, folder = fs.FileSystem.from_uri(path)
            out = store.open_output_stream(f"{folder}/{name}")
        n = 0
        with out:
            for batch in batches:
                for piece in slices(batch, text_column):
                    for tokens in encode([t or "" for t in piece.column(text_column).to_pylist()]):
                        tokens.append(SEPARATOR)
                        out.write(np.array(tokens, KIND).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * piece.num_rows), pa.array(np.arange(n, n + piece.num_rows)), piece.column(id_column)], names=["file", "doc_no", id_column])
                    n += piece.num_rows
        if local:
            os.replace(part, f"{local}/{name}")

    return path, kept(source.mapInArrow(task, f"file string, doc_no bigint, {id_column} bigint"), "manifest")


def read_block(path, offset, length):
    local = local_path(path)
    if local:
        with open(local, "rb") as f:
            f.seek(offset)
            return f.read(length)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        return f.read_at(length, offset)


def count_tokens(spark: SparkSession, path: str, separator: int = SEPARATOR, kind: str = KIND, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file``, ``doc_no`` (from 0), ``start`` and ``n_tokens`` of every document of the files in ``path``.

    ``start`` is the place of its first token in the file; the separator is not counted. Tokens after the last
    separator are a document of their own; an empty file has none. A file whose length is not a
    multiple of the width raises ``ValueError``.
    """
    width = np.dtype(kind).itemsize
    block_bytes = max(width, block_bytes // width * width)
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    if files.where(F.col("length") % width != 0).limit(1).count():
        raise ValueError("a token file ends within a token")
    blocks = files.select("path", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(block_bytes).cast("bigint"))).alias("block", "offset"), "length")
    blocks = blocks.select("path", F.col("block").cast("bigint"), "offset", F.least(F.lit(block_bytes), F.col("length") - F.col("offset")).alias("length"))

    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens = np.frombuffer(read_block(row["path"], row["offset"], row["length"]), kind)
                at = np.flatnonzero(tokens == separator)
                ended = np.diff(at, prepend=-1) - 1
                tail = len(tokens) - (at[-1] + 1 if len(at) else 0)
                yield pa.RecordBatch.from_pydict(
                    {"path": [row["path"]], "block": [row["block"]], "first": [row["offset"] // width], "ended": [ended.tolist()], "tail": [int(tail)]},
                    pa.schema([("path", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("ended", pa.list_(pa.int64())), ("tail", pa.int64())]),
                )

    seen = blocks.repartition(F.xxhash64("path", "block")).mapInArrow(task, "path string, block bigint, first bigint, ended array<bigint>, tail bigint")
    seen = kept(seen, "blocks")
    # prefix scan: documents ended before a block, and tokens open at its start
    facts = seen.select("path", "block", F.size("ended").cast("bigint").alias("ends"), "tail")
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marked = facts.withColumn("doc_no", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    # blocks between two with separators have the same number of documents before them
    run = Window.partitionBy("path", "doc_no").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_tail = F.last(F.when(F.col("ends") > 0, F.col("tail")), ignorenulls=True).over(earlier)
    inside = F.coalesce(F.sum(F.when(F.col("ends") == 0, F.col("tail"))).over(run), F.lit(0))
    marked = marked.withColumn("open", F.coalesce(last_tail, F.lit(0)) + inside)
    joined = seen.join(marked.select("path", "block", "doc_no", "open"), ["path", "block"])
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    ended = joined.select(name, "doc_no", "open", "first", F.posexplode("ended").alias("i", "n"), "ended")
    # start: what the block ended before it, with separators
    length = F.col("n") + F.when(F.col("i") == 0, F.col("open")).otherwise(0)
    body = ended.select("file", (F.col("doc_no") + F.col("i")).alias("doc_no"), "first", "i", "open", "n", length.alias("n_tokens"))
    within = Window.partitionBy("file", "first").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("first") + F.coalesce(F.sum(F.col("n") + 1).over(within), F.lit(0)) - F.when(F.col("i") == 0, F.col("open")).otherwise(0)
    body = body.select("file", "doc_no", begin.alias("start"), "n_tokens")
    final = joined.groupBy(name).agg(
        F.sum(F.size("ended")).cast("bigint").alias("doc_no"),
        F.max_by(F.col("tail") + F.when(F.size("ended") == 0, F.col("open")).otherwise(0), "block").alias("n_tokens"),
        F.max(F.col("first") + F.aggregate("ended", F.lit(0).cast("bigint"), lambda a, x: a + x + 1) + F.col("tail")).alias("length"),
    ).where("n_tokens > 0")
    return body.unionByName(final.select("file", "doc_no", (F.col("length") - F.col("n_tokens")).alias("start"), "n_tokens"))
