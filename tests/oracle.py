"""Run registered queries against their SQL twins: `python -m tests.oracle [sf_dir] [name ...]`."""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype") or type(value).__name__ == "Decimal":
        return f"{float(value):.6f}"
    return str(value)


def row_keys(frame: pd.DataFrame) -> list[str]:
    ordered = frame[sorted(frame.columns)]
    columns = [ordered[c].map(canonical).tolist() for c in ordered.columns]
    return sorted("\x1f".join(row) for row in zip(*columns)) if columns else []


def digest(frame: pd.DataFrame) -> str:
    return hashlib.md5("\n".join(row_keys(frame)).encode()).hexdigest()


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    """Empty when equal, else what differs."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} vs {len(sql_frame)}"
    a, b = row_keys(spark_frame), row_keys(sql_frame)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(diff)} rows differ, first: {diff[0][0]!r} vs {diff[0][1]!r}"
    kinds = {c: (spark_frame[c].dtype.kind, sql_frame[c].dtype.kind) for c in spark_frame.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and len(spark_frame) and "O" not in k}
    return f"types {odd}" if odd else ""


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from rubricon.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.001"
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    oracles = oracle_sql()
    for name, fn in queries().items():
        if args and name not in args:
            continue
        try:
            start = time.time()
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            start = time.time()
            problem = compare(got, con.sql(oracles[name]).df()) if name in oracles else "no oracle"
            print(f"{name:24s} {len(got):8d} rows {took:6.2f}s sql {time.time() - start:5.2f}s {problem or 'ok'}", flush=True)
            bad += bool(problem) and problem != "no oracle"
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"{name:24s} ERROR {str(error)[:1500]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
