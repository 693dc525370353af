"""Compare the catalogued queries with DuckDB on the same tables: ``python tests/oracle.py [sf] [query ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float) and v != v:
        return "nan"
    return f"{type(v).__name__}:{v!r}"


def differences(spark_df, relation) -> str:
    """Empty if both hold the same rows in any order, else what differs."""
    ours, theirs = spark_df.toArrow(), relation.to_arrow_table()
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(ours.column_names)} vs {sorted(theirs.column_names)}"
    names = sorted(ours.column_names)
    kinds = [(n, str(ours.schema.field(n).type), str(theirs.schema.field(n).type)) for n in names]
    odd = [k for k in kinds if k[1].replace("large_", "") != k[2].replace("large_", "").split("[")[0]]
    rows = [sorted(map(str, zip(*[map(_cell, t.column(n).to_pylist()) for n in names]))) for t in (ours, theirs)]
    if len(rows[0]) != len(rows[1]):
        return f"rows {len(rows[0])} vs {len(rows[1])}"
    bad = [(a, b) for a, b in zip(*rows) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows[0])} rows differ, e.g. {bad[0]}; types {odd}"
    return f"types {odd}" if odd else ""


if __name__ == "__main__":
    sys.path.insert(0, ROOT)
    from __spark_entry__ import oracle_sql, queries

    from driftmap.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_spark(
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, run in queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            sql = oracle_sql().get(name)
            if sql is None:
                note = f"{len(df.collect())} rows"
            else:
                note = differences(df, con.sql(sql)) or f"match {df.count() if not only else ''}"
                failed += not note.startswith("match")
        except Exception as e:  # report and go on with the other queries
            note, failed = "ERROR " + str(e).replace("\n", " ")[:600], failed + 1
        print(f"{name:30s} {time.time() - start:6.1f}s  {note}", flush=True)
    print("failed", failed)
