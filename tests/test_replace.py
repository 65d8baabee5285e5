"""Writes that replace, named shard files, manifests, walks and programs on files as they are."""

import gzip
import hashlib
import os
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowloom.operators.apply import map_files, packed_files, record_files
from rowloom.operators.inventory import file_inventory, pending_outputs
from rowloom.operators.row_index import with_row_index
from rowloom.operators.split import Shards, split_contiguous
from rowloom.plans.split_file import split_file
from rowloom.sinks.manifest import finished_outputs, read_manifest
from rowloom.sinks.replace import OLD, READY, _beside
from rowloom.sinks.shards import write_named_shards, write_shards
from rowloom.sinks.tables import write_table
from rowloom.sources import files
from rowloom.sources.files import list_files, walked
from rowloom.sources.parquet import index_parquet
from rowloom.sources.tables import read_table


def visible(path):
    return sorted(p.name for p in path.iterdir() if not p.name.startswith((".", "_")))


def leftovers(path):
    return [p.name for p in path.iterdir() if p.name.startswith(".rowloom")]


@pytest.mark.parametrize("name", ["t.parquet", "t.csv"])
def test_a_table_can_be_read_changed_and_written_back(spark, tmp_path, name):
    path = str(tmp_path / name)
    write_table(spark.range(100).toDF("id"), path)
    for step in (1, 2):
        write_table(read_table(spark, path).withColumn("id", F.col("id") + 1).where("id % 10 <> 0"), path)
    got = sorted(r.id for r in read_table(spark, path).collect())
    first = [i + 1 for i in range(100) if (i + 1) % 10]
    assert got == [i + 1 for i in first if (i + 1) % 10] and not leftovers(tmp_path)


@pytest.mark.parametrize("name", ["t.parquet", "t.csv"])
def test_a_write_that_fails_leaves_the_old_table(spark, tmp_path, name):
    path = str(tmp_path / name)
    write_table(spark.range(10).toDF("id"), path)
    broken = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        write_table(broken, path)
    assert read_table(spark, path).count() == 10 and not leftovers(tmp_path)


@pytest.mark.parametrize("state", [OLD, READY])
def test_a_replacement_that_died_is_finished(spark, tmp_path, state):
    path = str(tmp_path / "t.parquet")
    write_table(spark.range(10).toDF("id"), path)
    os.rename(path, _beside(path, state, "0" * 32))
    assert read_table(spark, path).count() == 10
    write_table(spark.range(3).toDF("id"), path)
    assert read_table(spark, path).count() == 3 and visible(tmp_path) == ["t.parquet"]


def test_a_new_version_goes_before_the_old_one(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    for state, rows in ((OLD, 3), (READY, 5)):
        spark.range(rows).write.parquet(_beside(path, state, "0" * 32))
    assert read_table(spark, path).count() == 5


def test_shards_do_not_replace_their_own_source(spark, tmp_path):
    source = tmp_path / "out" / "big.parquet"
    source.parent.mkdir()
    pd.DataFrame({"id": range(50)}).to_parquet(source)
    for path in (str(source), str(tmp_path / "o*" / "*.parquet")):
        with pytest.raises(ValueError, match="overlap"):
            write_shards(split_contiguous(index_parquet(spark, path), 3), str(tmp_path / "out"), mode="overwrite")
    assert spark.read.parquet(str(source)).count() == 50


def test_a_split_does_not_replace_what_a_pattern_names(spark, tmp_path):
    for d in "ab":
        (tmp_path / d).mkdir()
        (tmp_path / d / "x y.csv").write_text("id\n" + "".join(f"{i}\n" for i in range(20)))
    with pytest.raises(ValueError, match="overlap"):
        split_file(spark, str(tmp_path / "*" / "x y.csv"), 2, str(tmp_path / "a"), fmt="csv", mode="overwrite")
    assert all((tmp_path / d / "x y.csv").exists() for d in "ab")


def test_shards_are_replaced_when_the_new_ones_are_whole(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = with_row_index(spark.range(40).toDF("id"), ["id"])
    write_shards(split_contiguous(rows, 4), out)
    shards = split_contiguous(rows, 2)
    broken = shards.df.withColumn("id", F.when(F.col("id") == 30, F.raise_error(F.lit("no")).cast("bigint")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no"):
        write_shards(Shards(broken, 2, 40, shards.in_order, shards.widest, shards.spread), out, mode="overwrite")
    assert len(visible(tmp_path / "out")) == 4 and spark.read.parquet(out).count() == 40
    write_shards(shards, out, mode="overwrite")
    assert visible(tmp_path / "out") == ["shard_id=0", "shard_id=1"] and not leftovers(tmp_path)
    assert sorted((r.rel_path, r.rows) for r in read_manifest(spark, out).collect()) == [("shard_id=0", 20), ("shard_id=1", 20)]


def text_shards(spark, n, rows=20):
    scan = with_row_index(spark.range(rows).select("id", F.concat(F.lit("é"), F.col("id").cast("string")).alias("value")), ["id"])
    return split_contiguous(scan, n)


def test_named_files_and_their_manifest(spark, tmp_path):
    write_named_shards(text_shards(spark, 3), str(tmp_path), "x", ".txt")
    assert visible(tmp_path) == ["x.shard0000.txt", "x.shard0001.txt", "x.shard0002.txt"] and not leftovers(tmp_path)
    for row in read_manifest(spark, str(tmp_path)).collect():
        data = (tmp_path / row.rel_path).read_bytes()
        assert (row.files, row.bytes, row.rows, row.digest) == (1, len(data), data.count(b"\n"), hashlib.sha256(data).hexdigest())
    assert (tmp_path / "x.shard0001.txt").read_text() == "".join(f"é{i}\n" for i in range(6, 12))
    with pytest.raises(Exception, match="cannot be written"):
        write_named_shards(text_shards(spark, 3, 30), str(tmp_path), "x", ".txt")
    assert (tmp_path / "x.shard0001.txt").read_text().count("\n") == 6 and not leftovers(tmp_path)
    write_named_shards(text_shards(spark, 3, 30), str(tmp_path), "x", ".txt", replace_files=True)
    assert (tmp_path / "x.shard0001.txt").read_text().count("\n") == 10
    assert finished_outputs(spark, str(tmp_path)).count() == 3


def test_a_named_write_that_fails_leaves_nothing(spark, tmp_path):
    write_named_shards(text_shards(spark, 2), str(tmp_path), "x", ".txt")
    shards = text_shards(spark, 2, 30)
    broken = shards.df.withColumn("value", F.when(F.col("id") == 29, F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no"):
        write_named_shards(Shards(broken, 2, 30, shards.in_order), str(tmp_path), "x", ".txt", replace_files=True)
    assert (tmp_path / "x.shard0000.txt").read_text().count("\n") == 10 and not leftovers(tmp_path)
    assert visible(tmp_path) == ["x.shard0000.txt", "x.shard0001.txt"]


def test_named_parquet_keeps_types(spark, tmp_path):
    df = spark.range(10).select(
        "id", F.array("id", F.lit(None)).alias("a"), F.struct(F.lit("x").alias("s")).alias("t"), F.timestamp_seconds("id").alias("at"),
        F.col("id").cast("decimal(20,2)").alias("d"), F.create_map(F.lit("k"), "id").alias("m"), F.to_date(F.lit("2020-01-01")).alias("day"))
    write_named_shards(split_contiguous(with_row_index(df, ["id"]), 3), str(tmp_path), "x", ".parquet", fmt="parquet")
    back = spark.read.parquet(*[str(tmp_path / n) for n in visible(tmp_path)])
    assert dict(back.dtypes) == dict(df.dtypes)
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))


def test_half_written_shards_stay_pending(spark, tmp_path):
    out = str(tmp_path / "out")
    shards = text_shards(spark, 5, 50)
    some = Shards(shards.df.where("shard_id < 3"), 5, 50, shards.in_order)
    write_shards(some, out)
    expected = spark.range(5).select(F.format_string("shard_id=%d", "id").alias("rel_path"))

    def left():
        return sorted(r.rel_path for r in pending_outputs(spark, expected, out, manifest=True).collect())

    assert left() == ["shard_id=3", "shard_id=4"]
    spark.range(3).write.parquet(f"{out}/shard_id=3")
    assert left() == ["shard_id=3", "shard_id=4"]
    one = next((tmp_path / "out" / "shard_id=1").glob("part-*"))
    one.write_bytes(one.read_bytes()[:-1])
    assert left() == ["shard_id=1", "shard_id=3", "shard_id=4"]
    assert pending_outputs(spark, expected, str(tmp_path / "none"), manifest=True).count() == 5


@pytest.mark.parametrize("opened", [1, 3, 1000])
def test_walks_do_not_open_excluded_folders(spark, tmp_path, monkeypatch, opened):
    monkeypatch.setattr(files, "FIRST_OPENED", opened)
    monkeypatch.setattr(files, "OPENED", opened)
    deep = "/".join(f"d{i}" for i in range(12))
    keep = [f"{deep}/leaf", "a/x.txt", "a/b[1]/y.txt", "top"] + [f"w/{i}/f" for i in range(15)]
    gone = ["venv/lib/deep/er/x", "a/node_modules/m/x", "a/skip/x", "w/__pycache__/x"]
    for rel in keep + gone:
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text("x")
    patterns = ["venv", "node_modules/", "a/sk?p", "__*__"]
    rows = walked(spark, str(tmp_path), patterns=patterns).collect()
    assert sorted(r.rel_path for r in rows if r.kind == "file") == sorted(keep)
    folders = {""} | {"/".join(rel.split("/")[:i]) for rel in keep for i in range(1, rel.count("/") + 1)}
    assert sorted(r.rel_path for r in rows if r.kind == "opened") == sorted(folders)
    assert sorted(r.rel_path for r in file_inventory(spark, str(tmp_path), patterns=patterns).collect()) == sorted(keep)
    assert list_files(spark, str(tmp_path)).count() == len(keep + gone)


def test_a_folder_of_many_files_is_listed_in_batches(spark, tmp_path):
    for i in range(9000):
        (tmp_path / f"f{i:05d}").touch()
    rows = list_files(spark, str(tmp_path)).select("rel_path").collect()
    assert [r.rel_path for r in rows] == [f"f{i:05d}" for i in range(9000)]


def make_files(folder):
    folder.mkdir()
    (folder / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (folder / "b.csv").write_text("other header\n5\n")
    (folder / "c.gz").write_bytes(gzip.compress(b"packed\n" * 1000))
    (folder / "d.bin").write_bytes(bytes(range(256)) * 10_000)
    (folder / "e").write_bytes(b"")
    (folder / ".hidden").write_text("no")
    (folder / "_marked").write_text("yes")
    (folder / "sub").mkdir()
    (folder / "sub" / "f").write_text("no")


@pytest.mark.parametrize("task_bytes", [1, 1 << 30])
def test_programs_get_files_as_they_are(spark, tmp_path, task_bytes):
    def digest(shard_id, stream):
        sha, size = hashlib.sha256(), 0
        while block := stream.read(1 << 16):
            sha.update(block)
            size += len(block)
        stream.seek(0)
        yield pd.DataFrame({"name": [stream.path.rsplit("/", 1)[1]], "size": [size], "sha": [sha.hexdigest()], "first": [stream.read(1)]})

    make_files(tmp_path / "in")
    found = map_files(spark, str(tmp_path / "in"), digest, "name string, size bigint, sha string, first binary", "raw", expected=6, task_bytes=task_bytes)
    want = []
    for k, name in enumerate(["_marked", "a.csv", "b.csv", "c.gz", "d.bin", "e"]):
        data = (tmp_path / "in" / name).read_bytes()
        want.append((k, name, len(data), hashlib.sha256(data).hexdigest(), data[:1]))
    assert sorted((r.shard_id, r.name, r["size"], r.sha, bytes(r.first)) for r in found.collect()) == want
    with pytest.raises(ValueError, match="expected"):
        map_files(spark, str(tmp_path / "in"), digest, "name string", "raw", expected=5)
    with pytest.raises(ValueError, match="no shard files"):
        map_files(spark, str(tmp_path), digest, "name string", "raw")


def test_programs_on_files_may_yield_arrow_and_use_a_side_file(spark, tmp_path):
    make_files(tmp_path / "in")
    (tmp_path / "side.txt").write_text("7")

    def program(shard_id, stream, side):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"n": [int(open(side).read()) + shard_id]})

    found = map_files(spark, str(tmp_path / "in"), program, "n bigint", "raw", side=str(tmp_path / "side.txt")).collect()
    assert sorted((r.shard_id, r.n) for r in found) == [(k, 7 + k) for k in range(6)]


def test_outcomes_of_programs_on_files(spark, tmp_path):
    make_files(tmp_path / "in")

    def program(shard_id, stream):
        yield pd.DataFrame({"line": [stream.readline().decode("ascii")]})

    run = record_files(spark, str(tmp_path / "in"), program, "line string", run_id="r")
    ended = {r.shard_id: (r.status, r.rows_out, r.run_name) for r in run.outcome.collect()}
    assert [k for k, v in ended.items() if v[0] == "failed"] == [3]
    assert ended[1] == ("ok", 1, "r-shard-1-a-0")
    assert sorted((r.shard_id, r.line) for r in run.rows.collect()) == [(0, "yes"), (1, "x,y\n"), (2, "other header\n"), (4, bytes(range(11)).decode()), (5, "")]


def test_files_are_packed_by_bytes(spark, tmp_path):
    sizes = [10, 20, 5 << 20, 10, 3 << 20, 10, 10]
    for i, size in enumerate(sizes):
        (tmp_path / f"f{i}").write_bytes(b"x" * size)
    placed, count, bins = packed_files(spark, str(tmp_path), task_bytes=2 << 20)
    rows = sorted((r.shard_id, r.bin, r.length) for r in placed.collect())
    assert count == 7 and [r[0] for r in rows] == list(range(7)) and [r[2] for r in rows] == sizes
    assert sorted({r[1] for r in rows}) == list(range(bins)) and [r[1] for r in rows] == sorted(r[1] for r in rows)
    by_bin = pd.DataFrame(rows, columns=["shard", "bin", "length"]).groupby("bin")["length"].agg(["sum", "count"])
    # a bin begins with its first file and is full once its target is reached
    assert (by_bin["count"] <= 3).all()


def test_filters_on_inferred_columns_do_not_see_the_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,v\n1,2.5\n2,x\n")
    assert read_table(spark, str(tmp_path / "t.csv")).where("id % 2 = 0").collect()[0].v == "x"


@pytest.mark.parametrize("empty_folder", [False, True])
def test_entry_without_the_training_data_part(tmp_path, empty_folder):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "rowloom").mkdir()
    for name in os.listdir(f"{root}/rowloom"):
        if name != "llm":
            os.symlink(f"{root}/rowloom/{name}", tmp_path / "rowloom" / name)
    if empty_folder:
        (tmp_path / "rowloom" / "llm" / "__pycache__").mkdir(parents=True)
    (tmp_path / "__spark_entry__.py").write_text(open(f"{root}/__spark_entry__.py").read())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'split_orders' in q and not any(n.startswith('op') for n in q); assert set(q) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
