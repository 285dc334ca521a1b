"""Run registered queries in Spark and their oracle SQL in DuckDB; report mismatches.

usage: python tools/compare.py [--sf DIR] [name-substring ...]
"""
from __future__ import annotations

import argparse
import datetime as dt
import math
import sys
import time

import duckdb

sys.path.insert(0, ".")
from kassa.plans.registry import load_all  # noqa: E402
from kassa.session import build_session  # noqa: E402
from kassa.sources.testdata import RAW_TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(pdf):
    return sorted((tuple(norm(x) for x in r) for r in pdf.itertuples(index=False)), key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    reg = load_all()
    spark = build_session()
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    bad = 0
    for name, q in reg.items():
        if a.names and not any(s in name for s in a.names):
            continue
        t0 = time.time()
        try:
            sdf = q.run(spark, a.sf)
            sp = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {name}: {str(e)[:600]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = q.oracle()
        if sql is None:
            print(f"rows-only {name}: {len(sp)} rows ({ts:.1f}s)")
            continue
        try:
            dp = con.execute(sql).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL {name}: {str(e)[:600]}")
            bad += 1
            continue
        if list(sp.columns) != list(dp.columns):
            print(f"COLS {name}: {list(sp.columns)} vs {list(dp.columns)}")
            bad += 1
            continue
        rs, rd = rows_of(sp), rows_of(dp)
        if rs == rd:
            print(f"ok {name}: {len(rs)} rows ({ts:.1f}s)", flush=True)
        else:
            bad += 1
            sd, ss = set(rd), set(rs)
            diff_s = [r for r in rs if r not in sd][:3]
            diff_d = [r for r in rd if r not in ss][:3]
            print(f"MISMATCH {name}: spark {len(rs)} duck {len(rd)}\n  spark-only {diff_s}\n  duck-only {diff_d}", flush=True)
    print(f"bad={bad}")


if __name__ == "__main__":
    main()
