"""Run queries and their SQL twins side by side and compare every value.

    python tests/compare.py SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def spark_session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("eventide-tests")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "nan" if math.isnan(v) else repr(v + 0.0))
    return (3, f"{type(v).__name__}:{v}")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    s_cols, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(s_rows)
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    d_cols, d_rows = rows_of(cols, cur.fetchall())
    if s_cols != d_cols:
        return f"columns differ: {s_cols} / {d_cols}", len(s_rows)
    if len(s_rows) != len(d_rows):
        return f"row counts differ: {len(s_rows)} / {len(d_rows)}", len(s_rows)
    diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    if diff:
        return f"{len(diff)} of {len(s_rows)} rows differ, first:\n   {diff[0][0]}\n   {diff[0][1]}", len(s_rows)
    return "", len(s_rows)


def main(sf_dir, prefixes):
    import __spark_entry__ as E

    spark, con = spark_session(), duck(sf_dir)
    sql = E.oracle_sql()
    bad = 0
    for name, fn in E.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, con, name, fn, sql.get(name), sf_dir)
        except Exception as exc:
            problem, n = f"{type(exc).__name__}: {str(exc)[:600]}", -1
        state = "no twin" if problem is None else "ok" if problem == "" else "BAD"
        bad += state == "BAD"
        print(f"{state:8}{name:36}{n:8} rows {time.time() - start:6.2f} s {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
