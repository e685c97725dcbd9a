"""Run registered queries in Spark and their DuckDB statements, and compare
row count, column names and an order-insensitive value hash.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None or (isinstance(v, float) and pd.isna(v)):
        return "∅"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).tz_localize(None).isoformat() if getattr(v, "tzinfo", None) else pd.Timestamp(v).isoformat()
    return str(v)


def digest(pdf: pd.DataFrame) -> str:
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in pdf.to_dict("records"))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()[:16]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def diff_rows(a: pd.DataFrame, b: pd.DataFrame, n: int = 5) -> str:
    cols = sorted(a.columns)
    sa = {"|".join(_norm(r[c]) for c in cols) for r in a.to_dict("records")}
    sb = {"|".join(_norm(r[c]) for c in cols) for r in b.to_dict("records")}
    only_a = sorted(sa - sb)[:n]
    only_b = sorted(sb - sa)[:n]
    return f"cols={cols}\n  spark-only: {only_a}\n  duck-only: {only_b}"


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as entry
    from hashtrend.session import build_session

    spark = build_session()
    qs, sql = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        sp = qs[name](spark, sf_dir).toPandas()
        t1 = time.time()
        if name not in sql:
            print(f"{name:28s} rows={len(sp):7d} (no oracle) {t1 - t0:.1f}s")
            continue
        dk = con.execute(sql[name]).df()
        ok_cols = sorted(sp.columns) == sorted(dk.columns)
        ok = ok_cols and len(sp) == len(dk) and digest(sp) == digest(dk)
        bad += not ok
        print(f"{name:28s} rows={len(sp):7d}/{len(dk):7d} {'OK ' if ok else 'BAD'} spark={t1 - t0:.1f}s")
        if not ok:
            print("  ", list(sp.columns), list(dk.columns))
            if ok_cols:
                print("  ", diff_rows(sp, dk))
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
