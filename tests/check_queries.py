"""Compare every registered query with its SQL in DuckDB: python tests/check_queries.py [sf_dir] [names...]"""

import importlib.util
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry_under_test", f"{ROOT}/__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def duck(sf_dir):
    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr), [names[i] for i in order]


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def compare(spark, con, query, sql, sf_dir):
    """None when names, types and all values agree, else what differs."""
    df = query(spark, sf_dir)
    got, names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    want, want_names = rows_of(list(kinds), result.fetchall())
    if names != want_names:
        return f"columns {names} <> {want_names}"
    if dict(df.dtypes) != kinds:
        return f"types {dict(df.dtypes)} <> {kinds}"
    if got != want:
        first = next(((g, w) for g, w in zip(got, want) if g != w), None)
        return f"{len(got)} rows <> {len(want)} rows, first difference {first}"
    return None if got else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    entry = load_entry()
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    chosen, oracles, con = entry.queries(), entry.oracle_sql(), duck(sf_dir)
    bad = 0
    for name in sys.argv[2:] or chosen:
        begin = time.time()
        try:
            problem = compare(session, con, chosen[name], oracles[name], sf_dir)
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - begin:6.2f}s  {'ok' if problem is None else problem}", flush=True)
    print("all equal" if not bad else f"{bad} differ")
    sys.exit(bad > 0)
