"""Tables by path ending."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.sinks.replace import settle
from rowloom.sources.csv import index_csv, parse_records
from rowloom.sources.formats import is_parquet

# Texts that stand for a missing value in a CSV table.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# How numbers and truth values are spelled.
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|[iI]nf|[iI]nfinity)\s*$"
TRUE, FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")


def read_table(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """Parquet for ``.parquet`` and ``.pq``, anything else as CSV with a header (gzip by ending).

    CSV column types are inferred in one aggregation over the whole table: bigint, double,
    boolean, else string; dates stay text.  Whole numbers beyond bigint stay exact:
    decimal(38,0), or text if they have more digits.  ``schema`` (DDL) skips that pass.  Short rows are
    padded with missing values, rows with too many fields raise an error.
    """
    if not set("*?[{") & set(path):
        settle(spark, path)
    if is_parquet(path):
        return spark.read.parquet(path)
    texts = _texts(spark, path, multi_line)
    if schema is not None:
        fields = spark.createDataFrame([], schema).schema.fields
        if len(fields) != len(texts.columns):
            raise ValueError(f"the schema has {len(fields)} columns, the table {len(texts.columns)}")
        casts = [_quoted(c).cast(f.dataType).alias(f.name) for c, f in zip(texts.columns, fields)]
        return texts.select(*casts)
    types = infer_types(texts)
    return texts.select(*[_typed(c, types[c]) for c in texts.columns])


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _texts(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """String columns, blank lines dropped, missing values null."""
    records = index_csv(spark, path, multi_line)
    filled = replace(records, df=records.df.filter(F.col("value") != ""))
    parsed = parse_records(filled, "PAD")
    names = parsed.columns[:-2]
    return parsed.select(*[F.when(~_quoted(c).isin(*MISSING), _quoted(c)).alias(c) for c in names])


def infer_types(texts: DataFrame) -> dict[str, str]:
    """Narrowest type that holds every value of a string column; one partial aggregation."""

    def fits(c, test):
        return F.coalesce(F.bool_and(_quoted(c).isNull() | test), F.lit(True))

    checks = []
    for i, c in enumerate(texts.columns):
        value = _quoted(c)
        checks += [
            F.coalesce(F.bool_or(value.isNotNull()), F.lit(False)).alias(f"filled{i}"),
            fits(c, value.rlike(WHOLE) & value.try_cast("bigint").isNotNull()).alias(f"whole{i}"),
            fits(c, value.rlike(WHOLE)).alias(f"digits{i}"),
            fits(c, F.trim(value).try_cast("decimal(38,0)").isNotNull()).alias(f"exact{i}"),
            fits(c, value.rlike(NUMBER)).alias(f"number{i}"),
            fits(c, value.isin(*TRUE, *FALSE)).alias(f"truth{i}"),
        ]
    found = texts.agg(*checks).first().asDict()
    types = {}
    for i, c in enumerate(texts.columns):
        if found[f"filled{i}"] and found[f"whole{i}"]:
            types[c] = "bigint"
        elif found[f"filled{i}"] and found[f"digits{i}"]:
            types[c] = "decimal(38,0)" if found[f"exact{i}"] else "string"
        elif found[f"number{i}"]:
            types[c] = "double"
        else:
            types[c] = "boolean" if found[f"truth{i}"] else "string"
    return types


def _typed(name: str, kind: str) -> Column:
    value = _quoted(name)
    return (value if kind == "string" else F.trim(value).cast(kind)).alias(name)
