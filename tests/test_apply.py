import os
import subprocess
import sys

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rowloom.operators.apply import map_files, map_shards, overlay, record_shards
from rowloom.operators.split import split_contiguous
from rowloom.sinks.shards import write_shards
from rowloom.sources.directory import scan_shard_dir
from rowloom.sources.parquet import index_parquet

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def shards(spark, tmp_path):
    pq.write_table(pa.table({"id": range(1000), "g": [i % 3 for i in range(1000)]}), tmp_path / "d.parquet", row_group_size=90)
    return split_contiguous(index_parquet(spark, str(tmp_path / "d.parquet")), 7)


def summary(shard_id, batches):
    ids = [i for b in batches for i in b["id"]]
    assert ids == sorted(ids)
    yield pd.DataFrame({"rows": [len(ids)], "low": [ids[0]], "high": [ids[-1]]})


SUMMARY = "rows bigint, low bigint, high bigint"
WANT = [(k, 142 + (k == 6) * 6, k * 142, k * 142 + 141 + (k == 6) * 6) for k in range(7)]


def test_each_shard_runs_once(shards):
    assert sorted(map(tuple, map_shards(shards, summary, SUMMARY).collect())) == WANT


def test_pieces_need_no_shuffle_and_merge_to_the_same(spark, shards):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    pieces = map_shards(shards, summary, SUMMARY, whole=False)
    assert "Exchange" not in pieces._jdf.queryExecution().executedPlan().toString()
    merged = pieces.groupBy("shard_id").agg(F.sum("rows"), F.min("low"), F.max("high"))
    assert sorted(map(tuple, merged.collect())) == WANT
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_only_named_columns_are_read(shards):
    plan = map_shards(shards, summary, SUMMARY, columns=["id"])
    assert "ReadSchema: struct<id:bigint,_tmp" in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, plan.collect())) == WANT


def test_program_may_leave_rows_unread_or_yield_nothing(shards):
    def first(shard_id, batches):
        if shard_id % 2:
            yield next(batches).head(1)[["id"]]

    for whole in (True, False):
        rows = map_shards(shards, first, "id bigint", whole=whole).groupBy("shard_id").agg(F.min("id")).collect()
        assert sorted(map(tuple, rows)) == [(k, k * 142) for k in (1, 3, 5)]


def test_side_table_and_side_file(spark, shards, tmp_path):
    side = spark.createDataFrame([(0, "zero"), (1, "one"), (2, "two")], "g int, name string")

    def named(shard_id, batches, path):
        names = pd.read_parquet(path).set_index("g")["name"]
        for b in batches:
            yield b.assign(name=b["g"].map(names))[["id", "name"]]

    got = map_shards(shards, named, "id bigint, name string", side=side)
    assert got.filter("name = element_at(array('zero', 'one', 'two'), cast(id % 3 as int) + 1)").count() == 1000
    (tmp_path / "words.txt").write_text("hello")

    def word(shard_id, batches, path):
        yield pd.DataFrame({"w": [open(path).read()]})

    assert {r.w for r in map_shards(shards, word, "w string", side=str(tmp_path / "words.txt")).collect()} == {"hello"}


ON_EXECUTORS = """
import sys
import pandas as pd
from pyspark.sql import SparkSession
from rowloom import index_parquet, map_files, map_shards, split_contiguous

tmp = sys.argv[1]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": sys.argv[2]}
spark = SparkSession.builder.config(map=conf).getOrCreate()
side = spark.createDataFrame([(0, "zero"), (1, "one"), (2, "two")], "g int, name string")

def named(shard_id, batches, path):
    names = pd.read_parquet(path).set_index("g")["name"]
    for b in batches:
        yield b.assign(name=b["g"].map(names))[["id", "name"]]

def sized(shard_id, stream, path):
    yield pd.DataFrame({"rows": [len(pd.read_parquet(path))]})

shards = split_contiguous(index_parquet(spark, tmp + "/d.parquet"), 7)
got = map_shards(shards, named, "id bigint, name string", side=side)
assert got.filter("name = element_at(array('zero', 'one', 'two'), cast(id % 3 as int) + 1)").count() == 1000
assert [r.rows for r in map_files(spark, tmp + "/files", sized, "rows bigint", "raw", side=side).collect()] == [3]
spark.stop()
"""


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_side_table_reaches_executors(shards, tmp_path, scheme):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_text("x")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    args = [sys.executable, "-c", ON_EXECUTORS, str(tmp_path), f"{scheme}{tmp_path}/shared"]
    # a session of its own, in a process of its own: executors are not the driver
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))} | {"PYTHONPATH": root}
    done = subprocess.run(args, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_outcomes(spark, shards):
    def shaky(shard_id, batches):
        for b in batches:
            yield b[["id"]]
        if shard_id == 3:
            raise RuntimeError("broken")

    run = record_shards(shards, shaky, "id bigint", run_id="r1", config={"shard_id": "mine", "k": "v"})
    outcome = {r.shard_id: r for r in run.outcome.collect()}
    assert sorted(outcome) == list(range(7))
    assert [outcome[k].status for k in range(7)] == ["ok"] * 3 + ["failed"] + ["ok"] * 3
    assert outcome[3].error == "RuntimeError: broken" and outcome[0].error is None
    assert outcome[6].rows_out == 148 and outcome[2].run_name == "r1-shard-2-a-0"
    assert outcome[2].config == {"run_id": "r1", "attempt": "0", "shard_id": "mine", "k": "v"}
    rows = run.rows.collect()
    assert {r.shard_id for r in rows} == {0, 1, 2, 4, 5, 6} and len(rows) == 1000 - 142
    with pytest.raises(Exception, match="broken"):
        map_shards(shards, shaky, "id bigint").collect()


def test_overlay_without_config(spark):
    ids = F.create_map(F.lit("a"), F.lit("1"))
    assert spark.range(1).select(overlay(ids, {}), overlay(ids, {"a": "2"})).first()[:] == ({"a": "1"}, {"a": "2"})


def test_shard_dir_order_and_skips(spark, tmp_path):
    for name in ("shard2.txt", "shard10.txt", "shard1.txt", "shard 3+%.txt", ".DS_Store"):
        (tmp_path / name).write_text(f"{name}\nx\n")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.txt").write_text("x")
    (tmp_path / "_SUCCESS").write_text("")
    shards = scan_shard_dir(spark, str(tmp_path), "text", expected=5)
    got = sorted((r.shard_id, r.value) for r in shards.df.filter("value <> 'x'").collect())
    assert got == [(1, "shard 3+%.txt"), (2, "shard1.txt"), (3, "shard10.txt"), (4, "shard2.txt")]

    def count(shard_id, batches):
        yield pd.DataFrame({"rows": [sum(len(b) for b in batches)]})

    run = record_shards(shards, count, "rows bigint")
    assert sorted(map(tuple, run.rows.collect())) == [(0, 0), (1, 2), (2, 2), (3, 2), (4, 2)]
    assert run.outcome.count() == 5
    with pytest.raises(ValueError, match="expected"):
        scan_shard_dir(spark, str(tmp_path), "text", expected=3)
    (tmp_path / "_part.txt").write_text("x")
    with pytest.raises(ValueError, match="_part.txt"):
        scan_shard_dir(spark, str(tmp_path), "text")


def test_shard_dir_without_files(spark, tmp_path):
    with pytest.raises(ValueError):
        scan_shard_dir(spark, str(tmp_path))
    (tmp_path / ".hidden").write_text("x")
    with pytest.raises(ValueError):
        scan_shard_dir(spark, str(tmp_path))


def test_shard_dir_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,"x\ny"\n2,b\n')
    (tmp_path / "b.csv").write_text("id,v\n3,c\n")
    df = scan_shard_dir(spark, str(tmp_path)).df
    assert sorted((r.shard_id, r.id, r.v) for r in df.collect()) == [(0, "1", "x\ny"), (0, "2", "b"), (1, "3", "c")]
    (tmp_path / "c.parquet").write_bytes(b"")
    with pytest.raises(ValueError, match="several"):
        scan_shard_dir(spark, str(tmp_path))


@pytest.mark.parametrize("whole", [True, False])
def test_map_files(spark, shards, tmp_path, whole):
    write_shards(shards, str(tmp_path / "out"), one_file=True)
    got = map_files(spark, str(tmp_path / "out"), summary, SUMMARY, "parquet", expected=7, whole=whole)
    got = got.groupBy("shard_id").agg(F.sum("rows"), F.min("low"), F.max("high"))
    assert sorted(map(tuple, got.collect())) == WANT
