import csv
import glob
import io
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rowloom.operators.row_index import IndexedScan, with_row_index
from rowloom.operators.split import Shards, split_contiguous
from rowloom.plans.shard_plan import shard_plan
from rowloom.plans.split_file import split_file
from rowloom.sinks import shards as sinks
from rowloom.sinks.shards import stays_in_place, write_shards
from rowloom.sources.csv import index_csv
from rowloom.sources.formats import detect_format
from rowloom.sources.parquet import index_parquet
from rowloom.sources.text import index_text


def shard_files(out, k):
    """Files of one shard in part order."""
    return sorted(glob.glob(f"{out}/shard_id={k}/part-*"), key=lambda p: int(re.search(r"part-(\d+)", p)[1]))


def lines_of(out, k):
    return [line for f in shard_files(out, k) for line in open(f, newline="").read().split("\n")[:-1]]


def rows_of(out, k, header):
    rows = []
    for f in shard_files(out, k):
        first, *rest = csv.reader(open(f, newline=""))
        assert first == header
        rows += rest
    return rows


def blocks(items, n):
    """Shards of a list, worked out by slicing."""
    size = len(items) // n
    cuts = [k * size for k in range(n)] + [len(items)]
    return [items[a:b] for a, b in zip(cuts, cuts[1:])]


def test_detect_format():
    names = {"a.csv": "csv", "b.CSV": "csv", "a.parquet": "parquet", "a.pq": "parquet", "a.txt": "text", "a": "text"}
    assert {n: detect_format("/x.y/" + n) for n in names} == names


@pytest.mark.parametrize("total,n", [(1, 1), (97, 5), (23, 4), (50, 4), (6000, 7), (8, 8), (15, 8), (10**12 + 7, 3)])
def test_plan_sizes(spark, total, n):
    plan = shard_plan(spark, total, n, "data", ".csv").orderBy("shard_id").collect()
    sizes = [r.row_count for r in plan]
    assert sizes == [total // n] * (n - 1) + [total // n + total % n]
    assert [r.row_start for r in plan] == [total // n * k for k in range(n)]
    assert plan[-1].shard_name == f"data.shard{n - 1:04d}.csv"


def test_shard_arithmetic_is_exact_for_large_indexes(spark):
    total, n = 2**61 + 5, 3
    rows = spark.range(3).select((F.lit(total // n) * F.col("id") + F.col("id") - 1).alias("row_idx"))
    got = split_contiguous(IndexedScan(rows.filter("row_idx >= 0"), total, False), n).df
    assert sorted(r.shard_id for r in got.collect()) == [1, 2]


@pytest.mark.parametrize("n", [0, -1, 6])
def test_impossible_counts_raise_before_writing(spark, tmp_path, n):
    src = tmp_path / "d.txt"
    src.write_text("only\n" * 5)
    with pytest.raises(ValueError):
        split_file(spark, str(src), n, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_unknown_format(spark, tmp_path):
    (tmp_path / "d.txt").write_text("a\nb\nc\n")
    with pytest.raises(ValueError):
        split_file(spark, str(tmp_path / "d.txt"), 2, str(tmp_path / "out"), fmt="bogus")


@pytest.mark.parametrize("n", [1, 6, 83])
def test_text(spark, small_splits, tmp_path, n):
    lines = [f"{i * i} loaves" for i in range(83)]
    src = tmp_path / "data.txt"
    src.write_text("\n".join(lines))
    plan = split_file(spark, str(src), n, str(tmp_path / "out")).orderBy("shard_id").collect()
    assert [lines_of(tmp_path / "out", k) for k in range(n)] == blocks(lines, n)
    assert [r.row_count for r in plan] == [len(b) for b in blocks(lines, n)]
    assert all(glob.glob(r.path + "/part-*") for r in plan)


def test_text_line_ends(spark, tmp_path):
    (tmp_path / "d.txt").write_bytes(b"a\r\nb\rc\n\nd")
    split_file(spark, str(tmp_path / "d.txt"), 2, str(tmp_path / "out"))
    assert [lines_of(tmp_path / "out", k) for k in range(2)] == [["a", "b"], ["c", "", "d"]]


def test_text_directory_with_files_of_many_sizes(spark, small_splits, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    want = []
    for name, count in (("a.txt", 3), ("b c.txt", 200), ("d.txt", 1), ("e.txt", 90)):
        part = [f"{name}-{i}" for i in range(count)]
        (src / name).write_text("".join(x + "\n" for x in part))
        want += part
    scan = index_text(spark, str(src))
    got = [r.value for r in scan.df.orderBy("row_idx").collect()]
    assert got == want and scan.total == len(want)
    shards = split_contiguous(scan, 4)
    assert not shards.in_order
    write_shards(shards, str(tmp_path / "out"), "text", rows_per_file=25)
    assert [lines_of(tmp_path / "out", k) for k in range(4)] == blocks(want, 4)
    assert len(shard_files(tmp_path / "out", 0)) == 3


@pytest.mark.parametrize("n", [1, 4, 13])
def test_csv_header_and_rows(spark, small_splits, tmp_path, n):
    rows = [[str(i), "x\ny" * (i % 3) + '"' * (i % 2)] for i in range(80)]
    out = io.StringIO(newline="")
    csv.writer(out).writerows([["id", "no te"]] + rows)
    (tmp_path / "d.csv").write_bytes(out.getvalue().encode())
    split_file(spark, str(tmp_path / "d.csv"), n, str(tmp_path / "out"))
    assert [rows_of(tmp_path / "out", k, ["id", "no te"]) for k in range(n)] == blocks(rows, n)


def test_csv_ragged_rows_blank_lines_and_repeated_names_pass_through(spark, tmp_path):
    (tmp_path / "d.csv").write_text("x,x,y\n1\n\n1,2,3,4\n5,,\n")
    split_file(spark, str(tmp_path / "d.csv"), 2, str(tmp_path / "out"))
    got = [rows_of(tmp_path / "out", k, ["x", "x", "y"]) for k in range(2)]
    assert got == [[["1"], []], [["1", "2", "3", "4"], ["5", "", ""]]]


def test_csv_directory_out_of_order_gets_a_header_per_file(spark, small_splits, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = []
    for name, count in (("a.csv", 2), ("b.csv", 150), ("c.csv", 0), ("d.csv", 40)):
        part = [[name, str(i)] for i in range(count)]
        (src / name).write_text("f,i\n" + "".join(",".join(r) + "\n" for r in part))
        rows += part
    split_file(spark, str(src), 5, str(tmp_path / "out"), fmt="csv", rows_per_file=10)
    assert [rows_of(tmp_path / "out", k, ["f", "i"]) for k in range(5)] == blocks(rows, 5)


def test_parquet_rows_and_schema(spark, tmp_path):
    table = pa.table({"id": range(5000), "tags": [[i, None] for i in range(5000)], "s": [{"a": str(i)} for i in range(5000)]})
    pq.write_table(table, tmp_path / "d.parquet", row_group_size=300)
    split_file(spark, str(tmp_path / "d.parquet"), 7, str(tmp_path / "out"))
    for k, want in enumerate(blocks(list(range(5000)), 7)):
        parts = [pq.read_table(f, partitioning=None) for f in shard_files(tmp_path / "out", k)]
        assert [i for p in parts for i in p["id"].to_pylist()] == want
        assert parts[0].schema.names == ["id", "tags", "s"]
    back = spark.read.parquet(str(tmp_path / "out")).drop("shard_id")
    assert back.schema == spark.read.parquet(str(tmp_path / "d.parquet")).schema


def test_parquet_directory_keeps_file_order_and_pushes_filters(spark, tmp_path):
    for i, name in enumerate(("a b.parquet", "b.parquet", "c.parquet")):
        pq.write_table(pa.table({"id": range(i * 100, i * 100 + 100 - i), "pad": ["x" * i] * (100 - i)}), tmp_path / name)
    scan = index_parquet(spark, str(tmp_path))
    rows = scan.df.select("row_idx", "id").orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(297)) and [r.id for r in rows] == sorted(r.id for r in rows)
    few = scan.df.filter("id >= 205").select("row_idx", "id")
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,205)" in few._jdf.queryExecution().toString()
    assert sorted(few.first()) == [204, 205] or few.count() == 93


def test_key_order(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(5)
    with pytest.raises(ValueError, match="unique"):
        with_row_index(df, ["v"])
    with pytest.raises(ValueError):
        with_row_index(df, ["missing"])
    assert with_row_index(df.limit(0), ["k"]).total == 0
    with pytest.raises(ValueError, match="rename"):
        with_row_index(df.withColumn("row_idx", F.lit(1)), ["k"])
    scan = with_row_index(df, ["k"])
    assert scan.total == 1000 and scan.df.filter("row_idx <> k").count() == 0
    shards = split_contiguous(scan, 3)
    write_shards(shards, str(tmp_path / "out"), "csv")
    got = [rows_of(tmp_path / "out", k, ["k", "v"]) for k in range(3)]
    assert got == blocks([[str(i), "x"] for i in range(1000)], 3)


def test_in_order_write_has_no_shuffle(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "in"))
    shards = split_contiguous(index_parquet(spark, str(tmp_path / "in")), 4)
    assert shards.in_order
    assert "Exchange" not in shards.df._jdf.queryExecution().executedPlan().toString()
    write_shards(shards, str(tmp_path / "one"), one_file=True)
    files = sorted(glob.glob(str(tmp_path / "one" / "part-*")))
    assert [pq.read_table(f)["id"].to_pylist() for f in files] == blocks(list(range(1000)), 4)


@pytest.mark.parametrize("fmt", ["csv", "text", "parquet"])
def test_many_small_shards_from_one_partition_are_spread_over_tasks(spark, tmp_path, fmt):
    src = tmp_path / f"d.{'txt' if fmt == 'text' else fmt}"
    if fmt == "parquet":
        pq.write_table(pa.table({"value": [str(i) for i in range(700)]}), src)
    else:
        src.write_text("value\n" * (fmt == "csv") + "".join(f"{i}\n" for i in range(700)))
    split_file(spark, str(src), 200, str(tmp_path / "out"))
    want = blocks([str(i) for i in range(700)], 200)
    for k in range(200):
        files = shard_files(tmp_path / "out", k)
        if fmt == "parquet":
            got = [v for f in files for v in pq.read_table(f, partitioning=None)["value"].to_pylist()]
        elif fmt == "text":
            got = lines_of(tmp_path / "out", k)
        else:
            got = [r[0] for r in rows_of(tmp_path / "out", k, ["value"])]
        assert got == want[k]


def test_input_of_one_task_is_spread_for_writing(spark, tmp_path):
    import gzip

    lines = [f"{i}" for i in range(1000)]
    with gzip.open(tmp_path / "d.txt.gz", "wt") as out:
        out.write("\n".join(lines))
    shards = split_contiguous(index_text(spark, str(tmp_path / "d.txt.gz")), 3)
    assert stays_in_place(shards, 1000) and not stays_in_place(shards, 100)
    write_shards(shards, str(tmp_path / "out"), "text", rows_per_file=100)
    assert [lines_of(tmp_path / "out", k) for k in range(3)] == blocks(lines, 3)
    assert len(shard_files(tmp_path / "out", 0)) == 4


@pytest.mark.parametrize("kind", ["text", "csv", "quoted", "cut"])
def test_changed_splits_are_an_error_not_a_loss(spark, tmp_path, kind):
    field = {"quoted": '"a,b"', "cut": '"a\nb"'}.get(kind, "ab")
    path = tmp_path / "d.txt"
    path.write_text("k,v\n" + "".join(f"{i},{field}\n" for i in range(400)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        df = (index_text if kind == "text" else index_csv)(spark, str(path)).df.filter("row_idx >= 0")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        with pytest.raises(Exception, match="splits changed"):
            df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_changed_packing_of_whole_files_is_an_error(spark, tmp_path):
    for i, size in enumerate((400, 300, 299, 298)):
        (tmp_path / f"{i}.txt").write_text("abcdefghi\n" * (size // 10))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set(keys[1], "1")
        spark.conf.set(keys[2], "1")
        spark.conf.set(keys[0], "610")
        df = index_text(spark, str(tmp_path)).df
        assert df.agg(F.countDistinct("row_idx")).first()[0] == 40 + 30 + 29 + 29
        spark.conf.set(keys[0], "710")
        with pytest.raises(Exception, match="splits changed"):
            df.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


@pytest.mark.parametrize("fmt", ["csv", "text", "parquet"])
def test_runs_of_long_rows_are_shorter(spark, tmp_path, monkeypatch, fmt):
    monkeypatch.setattr(sinks, "RUN_BYTES", 4000)
    # files that Spark reads in another order than that of their names; long rows in the last
    values = [f"{i}" + "x" * (100 if i >= 300 else 0) for i in range(400)]
    src = tmp_path / f"d.{fmt}"
    src.mkdir()
    for name, part in (("a", values[:20]), ("b", values[20:300]), ("c", values[300:])):
        if fmt == "parquet":
            pq.write_table(pa.table({"value": part}), src / f"{name}.parquet", compression="none", use_dictionary=False)
        else:
            (src / f"{name}.txt").write_text("value\n" * (fmt == "csv") + "".join(f"{v}\n" for v in part))
    scan = {"csv": index_csv, "text": index_text, "parquet": index_parquet}[fmt](spark, str(src))
    assert not scan.in_order and scan.total == 400 and sum(size for _, size in scan.blocks) > 10_000
    runs = sinks.by_chunks(split_contiguous(scan, 3), 1000)
    sizes = runs.groupBy(F.spark_partition_id(), sinks.RUN).agg(F.sum(F.length("value") + 1).alias("size"), F.min("row_idx").alias("low"), F.max("row_idx").alias("high"), F.count("*").alias("rows"))
    found = sorted(tuple(r)[1:] for r in sizes.collect())
    assert max(size for _, size, *_ in found) <= 4500 and 3 <= len(found) <= 8
    assert all(run == low and high - low + 1 == rows for run, _, low, high, rows in found) and sum(r[-1] for r in found) == 400
    split_file(spark, str(src), 3, str(tmp_path / "out"), fmt=fmt)
    want = blocks(values, 3)
    for k in range(3):
        if fmt == "parquet":
            got = [v for f in shard_files(tmp_path / "out", k) for v in pq.read_table(f, partitioning=None)["value"].to_pylist()]
        else:
            got = lines_of(tmp_path / "out", k) if fmt == "text" else [r[0] for r in rows_of(tmp_path / "out", k, ["value"])]
        assert got == want[k]


def test_runs_with_blocks_in_which_no_row_begins():
    wide = Shards(None, 2, 6, False, blocks=((0, 100), (2, 100 << 20), (2, 100 << 20), (2, 100), (6, 50)))
    assert sinks.cell_runs(wide, 1000, 1).tolist() == [0, 1, 1, 1, 1, 1]
    assert sinks.cell_runs(wide, 2, 1).tolist() == [0, 1, 1, 2, 2, 3]
