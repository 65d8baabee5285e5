import csv
import io
import random

import pytest

from rowloom.functions import tasks
from rowloom.sources.csv import header_names, index_csv, scan_csv_verbatim


def read_csv(text):
    return list(csv.reader(io.StringIO(text, newline="")))


def write_bytes(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_quote_state_agrees_with_the_csv_module():
    rng = random.Random(7)
    for _ in range(30_000):
        line = "".join(rng.choice('"",ab \\') for _ in range(rng.randint(0, 12)))
        # A second line becomes a record of its own only when the first left no quote open.
        alone = read_csv(line + "\n" + "x\n")
        assert tasks.ends_in_quote(line, False) == (alone[-1] != ["x"]), line
        opened = read_csv('"' + "\n" + line + "\n" + "x\n")
        assert tasks.ends_in_quote(line, True) == (opened[-1] != ["x"]), line


def records(scan):
    rows = sorted(scan.df.select("row_idx", "value").collect())
    assert [r.row_idx for r in rows] == list(range(scan.total))
    return [r.value for r in rows]


@pytest.mark.parametrize("seed", range(8))
def test_records_in_many_splits_equal_the_csv_module(spark, small_splits, tmp_path, seed):
    rng = random.Random(seed)
    ending = rng.choice(["\n", "\r\n"])
    words = ["a", "bb", "", 'q"q', "line\nbreak", "crlf\r\nin", "lone\rreturn", ",", "é", " pad ", "long " * 40, "\n\n\n" * 30]
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=ending)
    writer.writerow(["id", "x", "y\nz" if seed % 2 else "y"])
    for i in range(120):
        writer.writerow([i, rng.choice(words), rng.choice(words)])
        if rng.random() < 0.05:
            out.write(ending)
    text = out.getvalue()
    path = write_bytes(tmp_path / "t.csv", text)
    # Without room for a broadcast the closing lines go through a shuffle.
    scan = index_csv(spark, path, tail_bytes=-1 if seed >= 4 else 1 << 20)
    assert ("REPARTITION_BY_NUM" in scan.df._jdf.queryExecution().executedPlan().toString()) == (seed >= 4)
    want = read_csv(text)
    got = [next(iter(read_csv(r)), []) for r in records(scan)]
    assert got == want[1:]
    assert read_csv(scan.header)[0] == want[0]


def test_no_line_break_in_fields_needs_no_shuffle(spark, small_splits, tmp_path):
    text = "id,v\r\n" + "".join(f'{i},"q,{i}"\r\n' for i in range(200))
    scan = index_csv(spark, write_bytes(tmp_path / "t.csv", text))
    plan = scan.df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan and "MapInArrow" not in plan
    assert records(scan) == [f'{i},"q,{i}"' for i in range(200)]
    fast = index_csv(spark, str(tmp_path / "t.csv"), multi_line=False)
    assert records(fast) == records(scan)


def test_lone_carriage_returns_end_records(spark, small_splits, tmp_path):
    text = 'id,v\r1,"a\rb"\r2,c\n3,"d\ne",f\r4,"x\r\ny"\r5,z\n' * 3
    scan = index_csv(spark, write_bytes(tmp_path / "t.csv", text))
    assert [read_csv(r)[0] for r in records(scan)] == read_csv(text)[1:]


@pytest.mark.parametrize("tail_bytes", [-1, 1 << 20])
def test_several_files_each_with_a_header(spark, small_splits, tmp_path, tail_bytes):
    for name, first in (("a b.csv", 0), ("b.csv", 50)):
        body = "".join(f'{i},"n\n{i}"\n' for i in range(first, first + 50))
        (tmp_path / name).write_text("id,note\n" + body)
    (tmp_path / "c.csv").write_text("id,note\n")
    scan = index_csv(spark, str(tmp_path), tail_bytes=tail_bytes)
    assert [read_csv(r)[0] for r in records(scan)] == [[str(i), f"n\n{i}"] for i in range(100)]


def test_verbatim_columns(spark, small_splits, tmp_path):
    text = 'id,a,b\n007,,""\n1, pad ,"he said ""hi"""\n2,"x\r\ny",\\\n\n3,NA,null\n'
    df = scan_csv_verbatim(spark, write_bytes(tmp_path / "t.csv", text))
    assert {f.dataType.simpleString() for f in df.schema} == {"string"}
    rows = {tuple(r) for r in df.collect()}
    assert rows == {("007", "", ""), ("1", " pad ", 'he said "hi"'), ("2", "x\r\ny", "\\"), ("", "", ""), ("3", "NA", "null")}


def test_ragged_rows_raise_unless_permitted(spark, tmp_path):
    path = write_bytes(tmp_path / "t.csv", "a,b\n1\n1,2,3\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        scan_csv_verbatim(spark, path).collect()
    rows = {tuple(r) for r in scan_csv_verbatim(spark, path, mode="PERMISSIVE").collect()}
    assert rows == {("1", ""), ("1", "2")}


def test_empty_file_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        scan_csv_verbatim(spark, write_bytes(tmp_path / "t.csv", ""))


def test_repeated_header_names():
    assert header_names("x,X,y") == ["x0", "X1", "y"]


def test_quote_left_open_raises(spark, small_splits, tmp_path):
    text = "a,b\n1,x\n" + '2,"open\n' + "line\n\n" * 300
    for tail_bytes in (-1, 1 << 20):
        with pytest.raises(ValueError, match="quoted field"):
            index_csv(spark, write_bytes(tmp_path / "t.csv", text), tail_bytes=tail_bytes)
