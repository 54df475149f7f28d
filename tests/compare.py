"""Compare a query with its SQL: python tests/compare.py <sf_dir> [name prefix ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples with columns in name order; nulls and number types made equal."""
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
            return None
        if hasattr(v, "item"):
            v = v.item()
        return float(v) if isinstance(v, int) and not isinstance(v, bool) else v

    rows = [tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def difference(actual: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """None if the tables are equal, else what differs."""
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} != {sorted(expected.columns)}"
    a, e = canonical(actual), canonical(expected)
    if len(a) != len(e):
        return f"{len(a)} rows != {len(e)}"
    for x, y in zip(a, e):
        for u, v in zip(x, y):
            same = u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 1e-9 * max(1.0, abs(v)))
            if not same:
                return f"{str(x)[:300]} != {str(y)[:300]}"
    return None


def main(sf: str, prefixes: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            actual = fn(spark, sf).toPandas()
            took = time.time() - start
            if name not in sqls:
                result = "no SQL"
            else:
                start = time.time()
                result = difference(actual, con.execute(sqls[name]).df()) or "ok"
            print(f"{name:28s} spark {took:6.2f}s sql {time.time() - start:6.2f}s rows {len(actual):7d} {result}", flush=True)
            failed += result not in ("ok", "no SQL")
        except Exception as e:  # report and go on
            failed += 1
            print(f"{name:28s} FAILED {str(e)[:1500]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
