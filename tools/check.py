"""Run queries on Spark and their SQL in DuckDB on the same tables, and compare the rows.

    python tools/check.py [-d FOLDER] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from barsift import plans  # noqa: E402
from barsift.session import local_session  # noqa: E402


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(frame.columns):
        s = frame[c]
        if s.dtype.kind == "M":
            s = s.dt.strftime("%Y-%m-%d")
        elif s.dtype == object:
            s = s.map(lambda v: None if v is None or v != v else (
                v if isinstance(v, (int, float, str, bool)) else str(v)[:10] if hasattr(v, "year") else v))
            try:
                s = s.astype(float)
            except (TypeError, ValueError):
                s = s.map(lambda v: None if v is None else str(v))
        elif s.dtype.kind in "biuf" or str(s.dtype) in ("Int64", "Int32", "boolean", "Float64"):
            s = s.astype(float)
        out[c] = s
    got = pd.DataFrame(out)
    return got.sort_values(list(got.columns), na_position="first").reset_index(drop=True)


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str | None:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(set(a.columns) ^ set(b.columns))}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    a, b = canonical(a), canonical(b)
    for c in a.columns:
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{c}: {(~same).sum()} of {len(a)} differ, first {x[i]!r} vs {y[i]!r}"
    return None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session(8)
    con = duckdb.connect()
    for f in sorted(os.listdir(args.d)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{args.d}/{f}'")
    queries, sql = plans.load(), plans.checks()
    names = [n for n in queries if not args.names or any(n == a or n.startswith(a) for a in args.names)]
    bad = []
    for n in names:
        t0 = time.time()
        try:
            got = queries[n](spark, args.d).toPandas()
            t1 = time.time()
            if n in sql:
                want = con.execute(sql[n]).df()
                note = compare(got, want)
            else:
                want, note = None, None
            dup = "" if not len(got) else ""
            state = "ok" if note is None else "BAD"
            print(f"{state:4s} {n:44s} rows={len(got):7d} spark={t1 - t0:6.2f}s sql={time.time() - t1:6.2f}s "
                  f"{'' if n in sql else '(no sql) '}{note or ''}{dup}", flush=True)
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:600]}"
            print(f"FAIL {n:44s} {note}", flush=True)
        if note:
            bad.append(n)
    print(f"{len(names) - len(bad)} of {len(names)} agree; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
