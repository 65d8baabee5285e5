"""Time the stages of a split on one file: python bench_files.py FILE N [N...]

Prints one JSON line per shard count; the second of two rounds is reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

import pandas as pd
from pyspark.sql import SparkSession

from rowloom import (
    detect_format,
    index_csv,
    index_parquet,
    index_text,
    map_shards,
    shard_plan,
    split_contiguous,
    split_file,
)
from rowloom.scratch import new_scratch

INDEX = {"csv": index_csv, "text": index_text, "parquet": index_parquet}


def consume(df):
    df.write.format("noop").mode("overwrite").save()


def row_counts(shard_id, batches):
    yield pd.DataFrame({"rows": [sum(len(batch) for batch in batches)]})


def stages(spark, path, n):
    seconds = {}

    def timed(name, work):
        begin = time.perf_counter()
        result = work()
        seconds[name] = round(time.perf_counter() - begin, 2)
        return result

    fmt = detect_format(path)
    scan = timed("index", lambda: INDEX[fmt](spark, path))
    timed("shard_plan", lambda: consume(shard_plan(spark, scan.total, n)))
    shards = split_contiguous(scan, n)
    timed("split_contiguous", lambda: consume(shards.df))
    timed("map_shards_whole", lambda: consume(map_shards(shards, row_counts, "rows bigint")))
    timed("map_shards_pieces", lambda: consume(map_shards(shards, row_counts, "rows bigint", whole=False)))
    timed("split_file", lambda: split_file(spark, path, n, new_scratch(spark, "bench")))
    return {"file": os.path.basename(path), "rows": scan.total, "n": n, "seconds": seconds}


if __name__ == "__main__":
    cpus = os.environ.get("BENCH_CPUS", "8")
    session = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    for count in sys.argv[2:]:
        stages(session, sys.argv[1], int(count))
        print(json.dumps(stages(session, sys.argv[1], int(count))), flush=True)
