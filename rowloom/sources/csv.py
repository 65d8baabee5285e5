"""CSV records with quoted fields that may hold line breaks, read in parallel.

Spark's own multi-line reader gives each file to one task.  Here the file is read as
lines, in splits.  Whether a split begins inside a quoted field follows from the lines
before it that hold quotes; those are reduced to one row per split, in both cases (begins
closed, begins open), and chained over that small table.  Files in which no record spans
lines are then never shuffled; otherwise one shuffle moves each split's first lines to the
task that owns the record they belong to.
"""

from __future__ import annotations

import csv as stdlib_csv
import io
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import tasks
from rowloom.operators.row_index import (
    FILE,
    LENGTH,
    M,
    PREFIX,
    START,
    IndexedScan,
    attach_blocks,
    before,
    block_sizes,
    broadcasts,
    count_blocks,
    files_of,
    position_columns,
    rises,
    widest,
)
from rowloom.scratch import checkpointed

LEAD = PREFIX + "lead"

# Characters of a record that spans lines.
RECORD_CHARS = 64 << 20
# Closing lines of records that cross a split are broadcast up to this size.
TAIL_BYTES = 64 << 20

SUMMARY = (
    "file string, start bigint, first_m bigint, last_m bigint, out0 bigint, recs0 bigint, "
    "out1 bigint, recs1 bigint, close_m bigint, head_recs bigint, odd boolean"
)


@dataclass(frozen=True)
class CsvScan(IndexedScan):
    """Records as text in ``value``; ``LEAD`` marks the first record of a partition."""

    header: str = ""


def index_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool = True, tail_bytes: int = TAIL_BYTES, record_chars: int = RECORD_CHARS
) -> CsvScan:
    """Records of a CSV file, or of several with one header each, in file order.

    ``multi_line=False`` promises that no field holds a line break and saves the look at
    the quotes.  A record that spans lines and has more than ``record_chars`` characters, as a
    stray quote makes it, is an error: here where it covers whole splits, else when it is read.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    placed = lines.select("value", *position_columns())
    special = F.col("value").contains('"') | _inner_return(F.col("value"))
    counted = count_blocks(
        placed,
        (F.count_if(special) if multi_line else F.lit(0).cast("bigint")).alias("special"),
        F.min_by(F.when(F.col(START) == 0, _without_return(F.col("value"))), M).alias("first_line"),
    )
    if counted.empty:
        raise ValueError(f"{path} is empty: a CSV file needs a header line")
    _same_headers(counted)
    blocks = _chain(counted, _quote_summary(placed, special) if counted["special"].sum() else None, record_chars)
    header = _header(lines, counted[FILE].iloc[0])
    _same_header_records(placed, counted, header)
    total = int(blocks["records"].sum()) - blocks[FILE].nunique()
    files, sizes = files_of(blocks), block_sizes(blocks, blocks["base"])
    in_place = broadcasts(blocks)
    in_order = rises(blocks["min_m"]) and in_place
    most = widest(blocks.assign(rows=blocks["records"]))
    if not blocks["spans"].any():
        return CsvScan(_lines_as_records(placed, blocks), total, in_order, most, files, sizes, header)
    if in_place:
        tails, size = _closing_lines(placed, blocks)
        if size <= tail_bytes:
            return CsvScan(_joined_in_place(placed, blocks, tails, record_chars), total, in_order, most, files, sizes, header)
    most = int(blocks["records"].max())
    return CsvScan(_joined_after_shuffle(placed, blocks, record_chars), total, True, most, files, sizes, header)


def _inner_return(value: Column) -> Column:
    """A carriage return before the last character."""
    return value.contains("\r") & (F.instr(value, "\r") < F.length(value))


def _same_headers(counted: pd.DataFrame) -> None:
    """Refuse files whose header lines differ: their columns would be mixed up."""
    heads = counted[counted[START] == 0]
    other = heads[heads["first_line"] != heads["first_line"].iloc[0]]
    if len(other):
        raise ValueError(
            f"{other[FILE].iloc[0]} begins with {other['first_line'].iloc[0][:200]!r}, "
            f"{heads[FILE].iloc[0]} with {heads['first_line'].iloc[0][:200]!r}: give files of one header"
        )


def _same_header_records(placed: DataFrame, counted: pd.DataFrame, header: str) -> None:
    """Refuse files that differ in a later line of a header of several lines."""
    count = header.count("\n") + 1
    if count == 1 or counted[FILE].nunique() == 1:
        return
    numbered = counted.assign(line=counted.groupby(FILE, sort=False)["rows"].transform(before) - counted["min_m"])
    heads = attach_blocks(placed, numbered, ["line"]).select(FILE, "value", (F.col("line") + F.col(M)).alias("line")).filter(F.col("line") < count)
    in_order = F.array_sort(F.collect_list(F.struct("line", "value")))  # ``count`` lines
    texts = heads.groupBy(FILE).agg(F.array_join(F.transform(in_order, lambda x: x["value"]), "\n").alias("head"))
    same = (F.col("head") == F.lit(header)) | F.col("head").startswith(header + "\r")
    other = texts.filter(~same).orderBy(FILE).first()
    if other is not None:
        raise ValueError(f"{other[FILE]} begins with {other.head[:200]!r}, others with {header[:200]!r}: give files of one header")


def _header(lines: DataFrame, first_file: str) -> str:
    """Header record of the first file; reads more lines only while a quote stays open."""
    first = lines.filter(F.col("_metadata.file_path") == first_file)
    taken = 1
    while True:
        rows = [row.value for row in first.select("value").take(taken)]
        record, is_open = "", False
        for line in rows:
            pieces = tasks.line_pieces(line)
            for i, piece in enumerate(pieces):
                is_open = tasks.ends_in_quote(piece, is_open)
                record += piece
                if not is_open:
                    return record
                record += "\r" if i < len(pieces) - 1 else line[len(line.rstrip("\r")) :] + "\n"
        if len(rows) < taken:
            return record
        taken *= 2


def _quote_summary(placed: DataFrame, special: Column) -> pd.DataFrame:
    quoted = placed.filter(special).select(
        F.col(FILE).alias("file"), F.col(START).alias("start"), F.col(M).alias("m"), "value"
    )
    return quoted.mapInArrow(tasks.summarize_quotes, SUMMARY).toPandas()


def _chain(blocks: pd.DataFrame, summary: pd.DataFrame | None, record_chars: int) -> pd.DataFrame:
    """Add to each block what its lines need to find their record.

    head: leading lines that belong to a record begun in an earlier block, ``holder``;
    records: records begun in the lines a block owns; spans: some line is not one record;
    base: index of the block's first data record; first: the block begins its file.
    """
    facts = {}
    if summary is not None:
        facts = {(s.file, s.start): s for s in summary.itertuples(index=False)}
    n = len(blocks)
    head, holders, records, spans, first, file_no = [0] * n, [0] * n, [0] * n, [False] * n, [False] * n, [0] * n
    file, holder, is_open, inside = None, 0, False, 0
    lengths = list(blocks[LENGTH])
    columns = zip(blocks[FILE], blocks[START], blocks["min_m"], blocks["rows"])
    for i, (block_file, start, min_m, rows) in enumerate(columns):
        if block_file != file:
            _closed(file, is_open)
            file, is_open, first[i] = block_file, False, True
        file_no[i] = file_no[i - 1] + first[i] if i else 0
        fact = facts.get((block_file, start))
        begun, head_begun, ends_open = (0 if is_open else rows), 0, is_open
        head[i] = rows if is_open else 0
        spans[i] = is_open
        if fact is not None:
            before_first, after_last = fact.first_m - min_m, rows - (fact.last_m - min_m) - 1
            ends_open = bool(fact.out1 if is_open else fact.out0)
            begun = (fact.recs1 if is_open else before_first + fact.recs0) + (0 if ends_open else after_last)
            spans[i] = is_open or fact.odd
            if is_open:
                head_begun = fact.head_recs
                head[i] = rows if fact.close_m < 0 else fact.close_m - min_m + 1
        # a block that lies in one field as a whole; a character has up to four bytes
        inside = inside + lengths[i] if is_open and head[i] == rows else 0
        if inside > 4 * record_chars:
            raise ValueError(f"{block_file} has a CSV record of more than {record_chars} characters that lasts past byte {start}")
        holders[i] = holder
        records[holder] += head_begun
        if head[i] < rows:
            holder = i
        records[i] += begun - head_begun
        is_open = ends_open
    _closed(file, is_open)
    out = blocks.assign(
        head=head, holder=holders, records=records, spans=spans, first=first, file_no=file_no, ordinal=range(n)
    )
    # Header records are not data: one for each earlier file, and the own file's.
    out["base"] = before(out["records"]) - out["file_no"] - (~out["first"]).astype("int64")
    return out


def _closed(file: str | None, is_open: bool) -> None:
    if is_open:
        raise ValueError(f"{file} ends inside a quoted field")


def _without_return(value: Column) -> Column:
    return F.when(value.endswith("\r"), F.left(value, F.length(value) - 1)).otherwise(value)


def _lines_as_records(placed: DataFrame, blocks: pd.DataFrame) -> DataFrame:
    """Every line is a record: number the lines, drop the header lines.

    The text of a header line is null here, so that filters which Catalyst moves ahead of ours
    never see it as a value.
    """
    first = blocks["first"].astype("int64")
    numbered = blocks.assign(
        base=blocks["base"] - blocks["min_m"] - first,
        header_m=blocks["min_m"].where(blocks["first"], -1),
        lead_m=-1,
    )
    filled = blocks[blocks["rows"] > first].sort_values("min_m")
    leaders = filled.index[~(filled["min_m"] // 2**33).duplicated()]
    numbered.loc[leaders, "lead_m"] = blocks["min_m"] + first
    return (
        attach_blocks(placed, numbered, ["base", "header_m", "lead_m"])
        .filter(F.col(M) != F.col("header_m"))
        .select(
            F.when(F.col(M) != F.col("header_m"), _without_return(F.col("value"))).alias("value"),
            (F.col("base") + F.col(M)).alias("row_idx"),
            (F.col(M) == F.col("lead_m")).alias(LEAD),
            FILE,
        )
    )


ASSEMBLED = "value string, row_idx bigint, lead boolean, file string"


def _assembled(lines: DataFrame, record_chars: int) -> DataFrame:
    return lines.select("value", "tail", "base", "header", "file").mapInArrow(
        lambda batches, assemble=tasks.assemble_records: assemble(batches, record_chars), ASSEMBLED
    ).withColumnsRenamed({"file": FILE, "lead": LEAD})


def _closing_lines(placed: DataFrame, blocks: pd.DataFrame) -> tuple[DataFrame, int]:
    """(per holder block the lines of later blocks that complete its last record, bytes).

    Less than one record for each block. The lines are written once to the shared folder;
    they are gathered into records only if the caller finds their size small enough.
    """
    owned = attach_blocks(placed, blocks, ["min_m", "head", "ordinal", "holder"]).filter(
        F.col(M) - F.col("min_m") < F.col("head")
    )
    lines = checkpointed(owned.select("holder", "ordinal", M, "value"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", M, "value")))
    text = F.array_join(F.transform(ordered, lambda line: line["value"]), "\n")
    tails = lines.groupBy("holder").agg(text.alias("text"))
    return tails, lines.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0


def _joined_in_place(placed: DataFrame, blocks: pd.DataFrame, tails: DataFrame, record_chars: int) -> DataFrame:
    """Join lines into records where they were read; ``tails`` is small."""
    ended = blocks.assign(last_m=blocks["min_m"] + blocks["rows"] - 1)
    own = attach_blocks(placed, ended, ["min_m", "head", "ordinal", "base", "first", "last_m"]).filter(
        F.col(M) - F.col("min_m") >= F.col("head")
    )
    ending = F.coalesce(F.concat(F.lit("+"), F.col("text")), F.lit("-"))
    lines = own.join(F.broadcast(tails), F.col("ordinal") == F.col("holder"), "left").select(
        "value",
        F.when(F.col(M) == F.col("last_m"), ending).alias("tail"),
        "base",
        F.col("first").alias("header"),
        F.col(FILE).alias("file"),
    )
    return _assembled(lines, record_chars)


def _joined_after_shuffle(placed: DataFrame, blocks: pd.DataFrame, record_chars: int) -> DataFrame:
    """Send each line to the block that owns its record, then join lines into records.

    Almost every line stays with its own block, so a reducer reads from one or two map
    tasks.
    """
    holder = blocks.loc[blocks["holder"]].reset_index(drop=True)
    named = blocks.assign(holder_base=holder["base"], holder_first=holder["first"])
    wanted = ["min_m", "head", "ordinal", "base", "first", "holder", "holder_base", "holder_first"]
    continues = F.col(M) - F.col("min_m") < F.col("head")
    owned = attach_blocks(placed, named, wanted).select(
        "value",
        F.lit(None).cast("string").alias("tail"),
        M,
        "ordinal",
        F.col(FILE).alias("file"),
        F.when(continues, F.col("holder")).otherwise(F.col("ordinal")).cast("int").alias("owner"),
        F.when(continues, F.col("holder_base")).otherwise(F.col("base")).alias("base"),
        F.when(continues, F.col("holder_first")).otherwise(F.col("first")).alias("header"),
    )
    return _assembled(owned.repartitionById(len(blocks), "owner").sortWithinPartitions("ordinal", M), record_chars)


def header_names(header: str) -> list[str]:
    """Column names of a header record; repeated names get their position appended."""
    names = next(stdlib_csv.reader(io.StringIO(header, newline="")), [])
    folded = [name.lower() for name in names]
    return [f"{name}{i}" if folded.count(name.lower()) > 1 else name for i, name in enumerate(names)]


def parse_records(scan: CsvScan, mode: str = "FAILFAST") -> DataFrame:
    """Records to string columns, next to ``row_idx`` and the file; empty fields stay "".

    Rows with fewer or more fields than the header: FAILFAST raises, PERMISSIVE pads and
    cuts, PAD pads the short ones and raises for the long ones.
    """
    names = header_names(scan.header)
    schema = ", ".join(f"c{i} string" for i in range(len(names) + (mode == "PAD")))
    options = {"mode": "PERMISSIVE" if mode == "PAD" else mode, "quote": '"', "escape": '"', "multiLine": "true"}
    # A blank record is a row of empty fields; the parser calls it malformed.
    record = F.from_csv(F.when(F.col("value") != "", F.col("value")), schema, options)
    parsed = scan.df.select(record.alias("r"), "row_idx", FILE)
    values = [F.coalesce(F.col(f"r.c{i}"), F.lit("")) for i in range(len(names))]
    if mode == "PAD":
        too_long = F.raise_error(F.lit("a CSV row has more fields than the header")).cast("string")
        values = [F.when(F.col(f"r.c{len(names)}").isNull(), value).otherwise(too_long) for value in values]
    return parsed.select(*[value.alias(name) for value, name in zip(values, names)], "row_idx", FILE)


def scan_csv_verbatim(
    spark: SparkSession, path: str, multi_line: bool = True, mode: str = "FAILFAST", record_chars: int = RECORD_CHARS
) -> DataFrame:
    """CSV with a header as string columns, no type inference, text kept as it is.

    Rows with too few or too many fields raise an error; ``mode="PERMISSIVE"`` pads or
    cuts them.  ``record_chars`` as for ``index_csv``.
    """
    scan = index_csv(spark, path, multi_line, record_chars=record_chars)
    return parse_records(scan, mode).drop("row_idx", FILE)
