"""Hash trees, attempts of shards, records and headers of CSV files that must be refused."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowloom import changed_ranges, fingerprint, hash_tree, index_csv, index_parquet, record_files, record_shards, scan_csv_verbatim, split_contiguous
from rowloom.operators.row_index import IndexedScan


def stored(spark, path, df, files):
    df.repartitionByRange(files, "id").sortWithinPartitions("id").write.parquet(str(path))
    return index_parquet(spark, str(path))


def nodes(tree):
    return sorted(tuple(r) for r in tree.collect())


def test_tree_does_not_depend_on_files(spark, tmp_path):
    rows = spark.range(1000).withColumn("v", F.col("id") * 0.5)
    first, second = (nodes(hash_tree(stored(spark, tmp_path / str(n), rows, n), 16, 4)) for n in (1, 5))
    assert first == second
    assert [sum(n[0] == level for n in first) for level in range(4)] == [63, 16, 4, 1]
    assert first[-1][:4] == (3, 0, 0, 1000) and all(sum(n[3] for n in first if n[0] == level) == 1000 for level in range(4))


def test_names_and_types_are_part_of_the_tree(spark):
    frames = [spark.sql(s).coalesce(1) for s in ("select 1L id, '2' y", "select '1' id, 2L y", "select 1L id, '2' z")]
    # the fingerprint of values alone does not tell these apart
    assert len({fingerprint(f).first().fingerprint for f in frames}) == 1
    roots = {nodes(hash_tree(IndexedScan(f.withColumn("row_idx", F.lit(0).cast("bigint")), 1, True)))[-1][-1] for f in frames}
    assert len(roots) == 3


def test_changed_ranges(spark, tmp_path):
    rows = spark.range(1000).withColumn("v", F.col("id") * 2)
    old = hash_tree(stored(spark, tmp_path / "old", rows, 3), 16, 4)
    edited = rows.withColumn("v", F.when(F.col("id").isin(17, 500, 501), -1).otherwise(F.col("v")))
    new = hash_tree(stored(spark, tmp_path / "new", edited, 2), 16, 4)
    assert sorted(tuple(r) for r in changed_ranges(old, new, 4).collect()) == [(16, 16, 16), (496, 16, 16)]
    assert changed_ranges(old, old, 4).count() == 0
    # other lengths, as far as other heights
    gone = [(at, min(16, 1000 - at), 0) for at in range(32, 1000, 16)]
    for total, want in ((1005, [(992, 8, 13)]), (1010, [(992, 8, 16), (1008, 0, 2)]), (20, [(16, 16, 4), *gone])):
        other = hash_tree(stored(spark, tmp_path / f"n{total}", spark.range(total).withColumn("v", F.col("id") * 2), 2), 16, 4)
        assert sorted(tuple(r) for r in changed_ranges(old, other, 4).collect()) == want


def test_plans_of_high_trees_stay_small(spark, tmp_path):
    rows = spark.range(300).withColumn("v", F.col("id") * 2)
    edited = rows.withColumn("v", F.when(F.col("id").isin(0, 299), -1).otherwise(F.col("v")))
    old, new = (hash_tree(stored(spark, tmp_path / name, df, 2), 2, 2) for name, df in (("old", rows), ("new", edited)))
    assert old.agg(F.max("level")).first()[0] == 8
    changed = changed_ranges(old, new, 2)
    plan = changed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3 and plan.count("Aggregate") == 0 and plan.count("LogicalRDD") == 4
    assert sorted(tuple(r) for r in changed.collect()) == [(0, 2, 2), (298, 2, 2)]


def test_tree_of_nothing(spark):
    none = IndexedScan(spark.range(0).withColumn("row_idx", F.col("id")), 0, True)
    tree = hash_tree(none)
    assert [n[:4] for n in nodes(tree)] == [(0, 0, 0, 0)]
    one = hash_tree(IndexedScan(spark.range(1).withColumn("row_idx", F.col("id")), 1, True))
    assert [tuple(r) for r in changed_ranges(tree, one).collect()] == [(0, 0, 1)] and changed_ranges(tree, tree).count() == 0


def test_failed_shards_run_again_alone(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    ran = str(tmp_path)

    def program(shard_id, batches):
        attempt = os.environ["ROWLOOM_ATTEMPT"]
        open(f"{ran}/ran-{shard_id}-{attempt}", "x").close()
        for b in batches:
            yield b[["id"]]
        if shard_id == 6 or shard_id in (1, 4) and attempt == "0":
            raise RuntimeError("broken")

    run = record_shards(split_contiguous(index_parquet(spark, str(tmp_path / "t")), 7), program, "id bigint", attempts=3)
    ledger = sorted((r.shard_id, r.attempt, r.status, r.rows_out) for r in run.outcome.collect())
    want = [(s, 0, "failed" if s in (1, 4, 6) else "ok", 16 if s == 6 else 14) for s in range(7)]
    want += [(1, 1, "ok", 14), (4, 1, "ok", 14), (6, 1, "failed", 16), (6, 2, "failed", 16)]
    assert ledger == sorted(want)
    assert sorted(r.id for r in run.rows.collect()) == list(range(84))
    assert sorted(n for n in os.listdir(ran) if n.startswith("ran")) == sorted(f"ran-{s}-{a}" for s, a, *_ in want)
    assert len({r.run_name for r in run.outcome.collect()}) == len(want)


def test_failed_files_run_again_alone(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"f{i}").write_text("x" * i)

    def program(shard_id, stream):
        yield pd.DataFrame({"n": [len(stream.read())]})
        if shard_id in (2, 5) and os.environ["ROWLOOM_ATTEMPT"] == "0":
            raise RuntimeError("broken")

    run = record_files(spark, str(tmp_path), program, "n bigint", attempts=2)
    assert sorted((r.shard_id, r.n) for r in run.rows.collect()) == [(i, i) for i in range(6)]
    assert sorted((r.shard_id, r.attempt) for r in run.outcome.collect()) == sorted([(i, 0) for i in range(6)] + [(2, 1), (5, 1)])
    with pytest.raises(ValueError, match="attempts"):
        record_files(spark, str(tmp_path), program, "n bigint", attempts=0)


def test_headers_that_differ_in_their_second_line(spark, small_splits, tmp_path):
    for name, header in (("a", '"a\nb",c'), ("b", '"a\nx",z')):
        (tmp_path / f"{name}.csv").write_text(header + "\n" + "1,2\n" * 100)
    with pytest.raises(ValueError, match="header"):
        scan_csv_verbatim(spark, str(tmp_path))
    (tmp_path / "b.csv").write_bytes(b'"a\nb",c\r\n' + b"3,4\n" * 100)
    assert scan_csv_verbatim(spark, str(tmp_path)).count() == 200


@pytest.mark.parametrize("splits", [256, 1 << 27])
def test_a_stray_quote_over_many_lines_raises(spark, tmp_path, splits):
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, str(splits))
    try:
        lines = [f"{i},x" for i in range(3000)]
        lines[5], lines[2900] = '5,"x', '2900,x"'
        (tmp_path / "t.csv").write_text("\n".join(["id,v", *lines]) + "\n")
        assert scan_csv_verbatim(spark, str(tmp_path / "t.csv")).count() == 105
        with pytest.raises(Exception, match="more than 1000 characters"):
            index_csv(spark, str(tmp_path / "t.csv"), record_chars=1000).df.count()
    finally:
        spark.conf.set(key, old)
