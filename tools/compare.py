"""Run registered queries and their SQL checks side by side.

    python tools/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from lexloom import catalog  # noqa: E402
from lexloom.catalog.views import BASE  # noqa: E402
from lexloom.session import build_session  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in sorted(BASE):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    return f"{float(v):.6f}" if type(v).__name__ == "Decimal" else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str):
    """(ok or None, rows, seconds, note)."""
    t = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    got = df.collect()
    sec = time.time() - t
    sql = catalog.ORACLES.get(name)
    if sql is None:
        return None, len(got), sec, "no SQL check"
    res = con.execute(sql)
    cols, want = [d[0] for d in res.description], res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, len(got), sec, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return True, len(a), sec, ""
    only_a = sorted(set(a) - set(b))[:2]
    only_b = sorted(set(b) - set(a))[:2]
    return False, len(a), sec, f"{len(a)} vs {len(b)} rows\n    spark {str(only_a)[:700]}\n    check {str(only_b)[:700]}"


def main():
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    sf_dir = f"/root/testdata/sf{a.sf}"
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name in a.names or list(catalog.QUERIES):
        try:
            ok, n, sec, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, n, sec, note = False, 0, 0.0, f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if ok else 'rows' if ok is None else 'FAIL'} {name:32s} {n:7d} rows {sec:6.2f}s {note}", flush=True)
        if ok is False:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
