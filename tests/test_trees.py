import fnmatch
import os
import random

import pytest
from pyspark.sql import functions as F

from rowloom.functions import tasks
from rowloom.functions.expressions import output_path
from rowloom.operators.fingerprint import fingerprint, fingerprint_tree
from rowloom.operators.inventory import (
    DEFAULT_EXCLUDES,
    changed_only,
    exclude_paths,
    file_inventory,
    ignore_patterns,
    inventory_totals,
    pending_outputs,
)
from rowloom.sinks.tables import write_table
from rowloom.sources.files import list_files
from rowloom.sources.tables import read_table


def make_tree(root):
    for rel, text in {"oven/bread.txt": "", "oven/rolls/rye.py": "dough = 12345", "venv/bin/run": "left out", "oven/.heat": "230",
                      "oven/rolls/node_modules/m.js": "left out", "oven/rolls/rye.pyc": "left out"}.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text(text)


def names(df):
    return sorted(r.rel_path for r in df.collect())


def test_listing_suffix_depth_and_missing(spark, tmp_path):
    for rel in ("dir/a.csv", "dir/b.txt", "dir/sub/d e+%.csv", "other/c.csv"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text("abc")
    (tmp_path / "dir" / "_empty").write_text("")
    rows = list_files(spark, str(tmp_path / "dir"), ".csv").collect()
    assert [(r.rel_path, r.length) for r in rows] == [("a.csv", 3), ("sub/d e+%.csv", 3)]
    assert rows[0].path == f"file:{tmp_path}/dir/a.csv"
    assert names(list_files(spark, str(tmp_path / "dir") + "/", "", recursive=False)) == ["_empty", "a.csv", "b.txt"]
    assert list_files(spark, str(tmp_path / "missing")).collect() == []


def test_a_store_that_cannot_be_listed_in_full_raises(spark, tmp_path, monkeypatch):
    def unknown(path):
        raise NotImplementedError("no such scheme")

    (tmp_path / "a").write_text("x")
    monkeypatch.setattr(tasks, "open_filesystem", unknown)
    for recursive in (True, False):
        with pytest.raises(NotImplementedError):
            list_files(spark, str(tmp_path), recursive=recursive).collect()


def test_default_excludes_keep_hidden_names_they_do_not_name(spark, tmp_path):
    make_tree(tmp_path)
    os.symlink(tmp_path, tmp_path / "oven" / "loop")
    files = file_inventory(spark, str(tmp_path))
    assert names(files) == ["oven/.heat", "oven/bread.txt", "oven/rolls/rye.py"]
    assert inventory_totals(files).first()[:] == (3, 16)
    assert names(file_inventory(spark, str(tmp_path), extra=[".heat"])) == ["oven/bread.txt", "oven/rolls/rye.py"]


@pytest.mark.parametrize("wide", [1, 3, 30])
def test_every_file_is_listed_once_whatever_the_shape(spark, tmp_path, wide):
    want = []
    for i in range(wide):
        for rel in (f"d{i}/a", f"d{i}/e/f/g{i}/b", f"d{i}/e/f/h/_c", "top"):
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text("x")
            want.append(rel)
    rows = list_files(spark, str(tmp_path)).collect()
    assert [r.rel_path for r in rows] == sorted(set(want))
    assert all(r.path == f"file:{tmp_path}/{r.rel_path}" and r.length == 1 for r in rows)


def test_ignore_files(spark, tmp_path):
    assert ignore_patterns(spark, str(tmp_path), ["x"]) == [*DEFAULT_EXCLUDES, "x"]
    (tmp_path / ".gitignore").write_text("# crumbs go\ncrumb-?\n \t\n\tflour/*.bag \n")
    assert ignore_patterns(spark, str(tmp_path), ["old"]) == ["crumb-?", "flour/*.bag", "old"]
    (tmp_path / ".dockerignore").write_text("")
    assert ignore_patterns(spark, str(tmp_path)) == []


def excluded(rel, patterns):
    """The meaning of a pattern, by hand: the walk does not descend into an excluded directory."""
    parts = rel.split("/")
    tried = ["/".join(parts[: i + 1]) for i in range(len(parts))] + parts
    cleaned = [p.strip().rstrip("/") for p in patterns]
    return any(fnmatch.fnmatchcase(t, p) for t in tried for p in cleaned if p)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_agree_with_shell_matching(spark, seed):
    rng = random.Random(seed)
    paths = ["/".join("".join(rng.choice("ab.c-[]!^&~|\\x ") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4)))
             for _ in range(300)]
    df = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    for _ in range(12):
        patterns = ["".join(rng.choice("ab.c*?[]!-^&~|\\/x ") for _ in range(rng.randint(1, 5))) for _ in range(2)]
        want = sorted(p for p in paths if not excluded(p, patterns))
        assert names(exclude_paths(df, patterns)) == want, patterns


def test_pattern_examples(spark):
    paths = ["data/x.csv", "a/data/x", "a.log", "logs/b.log/c", "!keep", "new\nline.log", "src/x"]
    df = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    assert names(exclude_paths(df, ["data/", "", "  "])) == sorted(set(paths) - {"data/x.csv", "a/data/x"})
    assert names(exclude_paths(df, ["*.log"])) == ["!keep", "a/data/x", "data/x.csv", "src/x"]
    assert names(exclude_paths(df, ["/src", "s*x"])) == sorted(set(paths) - {"src/x"})
    assert names(exclude_paths(df, [])) == sorted(paths)


def test_tree_fingerprint(spark, tmp_path):
    for d in "ab":
        make_tree(tmp_path / d)
    one, two = (fingerprint_tree(spark, str(tmp_path / d)).first() for d in "ab")
    assert one == two and one.file_count == 3 and one.total_bytes == 16
    small = fingerprint_tree(spark, str(tmp_path / "a"), piece_bytes=4).first()
    (tmp_path / "b" / "oven" / "rolls" / "rye.py").write_text("dough = 12354")
    assert fingerprint_tree(spark, str(tmp_path / "b")).first().fingerprint != one.fingerprint
    assert fingerprint_tree(spark, str(tmp_path / "b"), piece_bytes=4).first().fingerprint != small.fingerprint
    with pytest.raises(ValueError):
        fingerprint_tree(spark, str(tmp_path / "a"), patterns=["*"])


def test_moving_text_between_path_and_content_is_seen(spark, tmp_path):
    for d, name, text in (("a", "x", "yz"), ("b", "xy", "z")):
        (tmp_path / d).mkdir()
        (tmp_path / d / name).write_text(text)
    got = {fingerprint_tree(spark, str(tmp_path / d)).first().fingerprint for d in "ab"}
    assert len(got) == 2


def value(df, **kw):
    return fingerprint(df, **kw).first().fingerprint


def test_table_fingerprint_sees_contents_only(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("d"), F.array("id", F.lit(None)).alias("a"))
    base = value(df)
    assert value(df.repartition(7).orderBy(F.desc("id"))) == base
    assert value(df.union(df.filter("id = 3"))) != base
    assert value(df.union(df.filter("id = 3")).union(df.filter("id = 3"))) != base
    assert value(df.withColumn("d", F.when(F.col("id") != 9, F.col("d")))) != base
    texts = [("ab", "c"), ("a", "bc"), ("a", None), ("a", ""), ("a", "-")]
    assert len({value(spark.createDataFrame([t], "x string, y string")) for t in texts}) == len(texts)
    assert fingerprint(df.limit(0)).first().row_count == 0


def test_only_changed_shards_remain(spark):
    df = spark.range(100).select((F.col("id") % 4).cast("int").alias("shard_id"), "id")
    recorded = fingerprint(df, by=["shard_id"])
    changed = df.withColumn("id", F.when(F.col("id") == 42, -1).otherwise(F.col("id")))
    assert [r.shard_id for r in changed_only(fingerprint(changed, by=["shard_id"]), recorded).collect()] == [2]
    assert changed_only(recorded, recorded).count() == 0


def test_pending_outputs(spark, tmp_path):
    for rel in ("a/x.csv", "shard_id=1/part-0", "b.csv"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text("x")
    wanted = ["a/x.csv", "a/y.csv", "shard_id=1", "shard_id=1/", "shard_id=2", "b.csv", "b"]
    expected = spark.createDataFrame([(w,) for w in wanted], "rel_path string")
    assert names(pending_outputs(spark, expected, str(tmp_path))) == ["a/y.csv", "b", "shard_id=2"]
    assert names(pending_outputs(spark, expected, str(tmp_path / "none"))) == sorted(wanted)
    (tmp_path / "shard_id=2" / "deep").mkdir(parents=True)
    (tmp_path / "shard_id=2" / "part-0").write_text("x")
    (tmp_path / "shard_id=2" / "deep" / "_SUCCESS").write_text("")
    (tmp_path / "shard_id=1" / "_SUCCESS").write_text("")
    assert names(pending_outputs(spark, expected, str(tmp_path))) == ["a/y.csv", "b"]
    assert names(pending_outputs(spark, expected, str(tmp_path), finished="_SUCCESS")) == ["a/y.csv", "b", "shard_id=2"]
    assert spark.range(1).select(output_path("gs://b/base//", F.lit("sub/o.txt"))).first()[0] == "gs://b/base/sub/o.txt"


def test_read_table_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "i,f,b,s,d,n,m,big\n007,1.5,True,x,2020-01-01,,1,1\n\n 8,-2e3,false,NA,2020-01-02,NA,NA,99999999999999999999\n"
    )
    df = read_table(spark, str(tmp_path / "t.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string", "double", "bigint", "decimal(38,0)"]
    assert sorted(map(tuple, df.select("i", "f", "b", "s", "d", "n", "m").collect())) == [
        (7, 1.5, True, "x", "2020-01-01", None, 1), (8, -2000.0, False, None, "2020-01-02", None, None)]
    typed = read_table(spark, str(tmp_path / "t.csv"), "i int, f double, b boolean, s string, d date, n string, m int, big double")
    assert dict(typed.dtypes)["d"] == "date" and typed.count() == 2
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "t.csv"), "i int")


def test_read_table_ragged_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,2,3\n4\n")
    df = read_table(spark, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, df.collect())) == [(1, 2, 3), (4, None, None)]
    (tmp_path / "t.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="more fields"):
        read_table(spark, str(tmp_path / "t.csv")).collect()


@pytest.mark.parametrize("name", ["t.csv", "t.parquet", "t.pq", "t"])
def test_table_round_trip(spark, tmp_path, name):
    df = spark.createDataFrame([(1, 'a "b"\nc', 0.5), (2, " pad ", -1.0), (3, "\\", 2.0)], "k bigint, t string, v double")
    for _ in range(2):
        write_table(df, str(tmp_path / name))
    back = read_table(spark, str(tmp_path / name))
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())


def test_gzip_csv(spark, tmp_path):
    spark.range(10).coalesce(1).write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "t"))
    assert read_table(spark, str(tmp_path / "t")).agg(F.sum("id")).first()[0] == 45
