"""Compare registered queries with their SQL: ``python tests/oracle_check.py FOLDER [name ...]``."""

from __future__ import annotations

import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def norm(v) -> str:
    return f"{float(v):.6f}" if isinstance(v, (float, decimal.Decimal)) else str(v)


def rows_of(table) -> list:
    cols = sorted(table.column_names)
    return sorted(repr(tuple(norm(v) for v in row)) for row in zip(*(table.column(c).to_pylist() for c in cols)))


def kind_of(kind) -> str:
    import pyarrow.types as t

    if t.is_string(kind) or t.is_large_string(kind):
        return "string"
    return "decimal" if t.is_decimal(kind) else str(kind)


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder: str, name: str, fn, sql: str | None):
    began = time.time()
    got = fn(spark, folder).toArrow()
    spark_s = time.time() - began
    if sql is None:
        return got.num_rows > 0, f"{got.num_rows} rows (no SQL)", spark_s, 0.0
    began = time.time()
    want = con.execute(sql).to_arrow_table()
    sql_s = time.time() - began
    if sorted(got.column_names) != sorted(want.column_names):
        return False, f"columns {sorted(got.column_names)} / {sorted(want.column_names)}", spark_s, sql_s
    kinds = {c: (kind_of(got.schema.field(c).type), kind_of(want.schema.field(c).type)) for c in got.column_names}
    apart = {c: k for c, k in kinds.items() if k[0] != k[1]}
    if apart:
        return False, f"types {apart}", spark_s, sql_s
    a, b = rows_of(got), rows_of(want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return False, f"{len(a)} / {len(b)} rows; {str(only_a)[:600]} / {str(only_b)[:600]}", spark_s, sql_s
    return True, f"{len(a)} rows", spark_s, sql_s


def main() -> int:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    sql = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            ok, note, a, b = compare(spark, con, folder, name, fn, sql.get(name))
        except Exception as problem:
            ok, note, a, b = False, f"{type(problem).__name__}: {str(problem)[:700]}", 0.0, 0.0
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:28s} spark {a:6.2f}s  sql {b:6.2f}s  {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
