"""Nothing is lost, mixed up or silently changed."""

from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowloom import scratch
from rowloom.operators import row_index
from rowloom.operators.apply import map_shards
from rowloom.operators.fingerprint import fingerprint
from rowloom.operators.row_index import with_row_index
from rowloom.operators.split import split_contiguous
from rowloom.plans.split_file import split_file
from rowloom.sources import directory, parquet
from rowloom.sources.csv import index_csv, scan_csv_verbatim
from rowloom.sources.directory import scan_shard_dir
from rowloom.sources.tables import read_table
from rowloom.sources.text import index_text


def test_split_beside_its_source_keeps_all_that_is_there(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id,v\n" + "".join(f"{i},x\n" for i in range(20)))
    (tmp_path / "other.bin").write_text("keep")
    split_file(spark, str(tmp_path / "big.csv"), 4, str(tmp_path))
    assert (tmp_path / "other.bin").read_text() == "keep"
    assert (tmp_path / "big.csv").read_text().count("\n") == 21
    assert len(list(tmp_path.glob("shard_id=*"))) == 4
    with pytest.raises(FileExistsError):
        split_file(spark, str(tmp_path / "big.csv"), 4, str(tmp_path))
    with pytest.raises(ValueError, match="overlap"):
        split_file(spark, str(tmp_path / "big.csv"), 4, str(tmp_path), mode="overwrite")
    assert (tmp_path / "big.csv").exists()


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,x\n")
    (tmp_path / "b.csv").write_text("v,id\ny,2\n")
    for call in (lambda: scan_csv_verbatim(spark, str(tmp_path)), lambda: scan_shard_dir(spark, str(tmp_path)),
                 lambda: split_file(spark, str(tmp_path), 1, str(tmp_path) + "-out", fmt="csv")):
        with pytest.raises(ValueError, match="header"):
            call()


@pytest.mark.parametrize("body", ['id,note\n1,"open\n2,x\n3,y\n', '"id,note\n1,x\n2,y\n'])
def test_unclosed_quotes_raise(spark, tmp_path, body):
    (tmp_path / "t.csv").write_text(body)
    with pytest.raises(ValueError, match="quoted field"):
        index_csv(spark, str(tmp_path / "t.csv"))


def test_side_files_of_one_name(spark, tmp_path):
    shards = split_contiguous(with_row_index(spark.range(6).toDF("id"), ["id"]), 2)

    def program(shard_id, batches, side):
        value = int(open(side).read())
        for batch in batches:
            yield pd.DataFrame({"sum": [int(batch.id.sum()) + value]})

    for value in (100, 200):
        (tmp_path / str(value)).mkdir()
        (tmp_path / str(value) / "side.txt").write_text(str(value))
        got = map_shards(shards, program, "sum bigint", side=str(tmp_path / str(value) / "side.txt")).collect()
        assert sorted(r["sum"] for r in got) == [value + 3, value + 12]


def test_large_whole_numbers_stay_exact(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n18446744073709551615," + "9" * 40 + "\n18446744073709551614,1\n")
    rows = read_table(spark, str(tmp_path / "t.csv"))
    assert [k for _, k in rows.dtypes] == ["decimal(38,0)", "string"]
    assert sorted(r.a for r in rows.collect()) == [Decimal("18446744073709551614"), Decimal("18446744073709551615")]


def test_fingerprints_ignore_time_zone_and_map_order(spark):
    def prints(zone, keys):
        spark.conf.set("spark.sql.session.timeZone", zone)
        at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
        pairs = F.create_map(*[x for k in keys for x in (F.lit(k), F.struct(at.alias("t")))])
        return fingerprint(spark.range(5).select(at.alias("a`b"), pairs.alias("m"), F.array(at).alias("l"))).collect()

    try:
        first = prints("UTC", "ab")
        assert first == prints("Asia/Tokyo", "ba")
        assert first != prints("UTC", "ac")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_subfolders_like_partitions_are_left_out(spark, tmp_path):
    for name in ("p[1].csv", "p 2.csv"):
        (tmp_path / name).write_text("id\n1\n2\n")
    (tmp_path / "k=v").mkdir()
    (tmp_path / "k=v" / "c.csv").write_text("id\n9\n")
    shards = scan_shard_dir(spark, str(tmp_path))
    assert shards.n == 2 and sorted(r.id for r in shards.df.collect()) == ["1", "1", "2", "2"]


@pytest.mark.parametrize("fmt", ["csv", "text", "parquet"])
def test_named_shards_come_back_as_a_shard_directory(spark, tmp_path, fmt):
    source, out = tmp_path / {"csv": "d.csv", "text": "d.log.gz", "parquet": "d.pq"}[fmt], tmp_path / "out"
    if fmt == "parquet":
        pd.DataFrame({"value": [str(i) for i in range(50)]}).to_parquet(source)
    elif fmt == "csv":
        source.write_text("value\n" + "".join(f"{i}\n" for i in range(50)))
    else:
        import gzip

        source.write_bytes(gzip.compress("".join(f"{i}\n" for i in range(50)).encode()))
    out.mkdir()
    (out / ".keep").write_text("mine")
    plan = split_file(spark, str(source), 4, str(out), fmt=fmt, one_file=True).orderBy("shard_id").collect()
    ending = {"csv": "d.shard%04d.csv", "text": "d.log.shard%04d.txt", "parquet": "d.shard%04d.pq"}[fmt]
    assert [r.path for r in plan] == [str(out / (ending % k)) for k in range(4)]
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith(".")) == [ending % k for k in range(4)]
    assert (out / ".keep").read_text() == "mine" and not list(out.glob(".rowloom-*"))
    shards = scan_shard_dir(spark, str(out), expected=4)
    want = [(min(i // 12, 3), str(i)) for i in range(50)]
    assert [(r.shard_id, r.value) for r in shards.df.orderBy("row_idx").collect()] == want
    with pytest.raises(FileExistsError):
        split_file(spark, str(source), 4, str(out), fmt=fmt, one_file=True)
    split_file(spark, str(source), 4, str(out), fmt=fmt, one_file=True, mode="overwrite")
    assert scan_shard_dir(spark, str(out), expected=4).df.count() == 50


@pytest.mark.parametrize("kind", ["text", "csv", "parquet", "folder"])
def test_block_tables_too_large_to_broadcast_give_the_same_rows(spark, small_splits, tmp_path, monkeypatch, kind):
    for module in (scratch, row_index, parquet, directory):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    values = []
    for name, count in (("a", 30), ("b", 170)):
        part = [f"{name}{i}" for i in range(count)]
        values += part
        if kind == "parquet":
            pd.DataFrame({"value": part}).to_parquet(tmp_path / f"{name}.parquet")
        else:
            (tmp_path / f"{name}.csv").write_text("value\n" * (kind != "text") + "".join(f"{v}\n" for v in part))
    read = {"text": index_text, "csv": index_csv, "parquet": parquet.index_parquet, "folder": scan_shard_dir}[kind]
    scan = read(spark, str(tmp_path))
    assert not scan.in_order
    assert [r.value for r in scan.df.orderBy("row_idx").collect()] == values


@pytest.mark.parametrize("tail_bytes", [0, 1 << 20])
def test_records_across_splits_with_any_bound_on_gathered_lines(spark, small_splits, tmp_path, tail_bytes):
    rows = [(str(i), "x\ny" * (i % 40)) for i in range(120)]
    (tmp_path / "t.csv").write_text("id,v\n" + "".join(f'{i},"{v}"\n' for i, v in rows))
    scan = index_csv(spark, str(tmp_path / "t.csv"), tail_bytes=tail_bytes)
    assert [r.value for r in scan.df.orderBy("row_idx").collect()] == [f'{i},"{v}"' for i, v in rows]
