"""Compares every query with its SQL oracle, column by column, rows in any order: python tests/oracle.py [SF_DIR] [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str:
    """Empty if they agree, else what differs."""
    want = con.sql(sql)
    if sorted(want.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(want.columns)}"
    got, expected = rows_of(df.columns, map(tuple, df.collect())), rows_of(want.columns, want.fetchall())
    if len(got) != len(expected):
        return f"{len(got)} and {len(expected)} rows; first apart: {next(((a, b) for a, b in zip(got, expected) if a != b), None)}"
    return next((f"{a} and {b}" for a, b in zip(got, expected, strict=True) if a != b), "")


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, con = entry.queries(), entry.oracle_sql(), views(sf)
    bad = 0
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            said = compare(queries[name](spark, sf), con, oracles[name]) if name in oracles else f"rows: {queries[name](spark, sf).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        ok = not said or said.startswith("rows:")
        bad += not ok
        print("ok  " if ok else "BAD ", name, f"{time.time() - began:.1f}s", said[:700], flush=True)
    print("bad:", bad)
    sys.exit(bool(bad))
