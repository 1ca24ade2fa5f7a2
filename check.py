"""Compare registered queries with their SQL on one data folder: ``check.py [--sf 0.01] [name...]``."""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

from plumbline.plans import ORACLES, QUERIES
from plumbline.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, norm(v)) for k, v in value.items())
    return value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("names", nargs="*")
    opt = args.parse_args()
    folder = f"/root/testdata/sf{opt.sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    spark = local_session(8)
    bad = []
    names = [n for n in QUERIES if not opt.names or any(n == p or n.startswith(p.rstrip("*")) and p.endswith("*")
                                                       for p in opt.names)]
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, folder)
            table = df.toArrow()
            rows = [tuple(r.values()) for r in table.to_pylist()]
            took = time.time() - t0
            if name not in ORACLES:
                print(f"rows  {name:34s} {len(rows):8d} rows {took:6.2f}s", flush=True)
                continue
            cur = con.execute(ORACLES[name])
            cols = [d[0] for d in cur.description]
            want = canonical(cols, cur.fetchall())
            got = canonical(df.columns, rows)
            ok = sorted(cols) == sorted(df.columns) and want == got
            print(f"{'ok   ' if ok else 'DIFF '} {name:34s} {len(rows):8d} rows {took:6.2f}s", flush=True)
            if not ok:
                bad.append(name)
                print("   columns", sorted(df.columns), "" if sorted(cols) == sorted(df.columns) else sorted(cols))
                print("   rows", len(got), "want", len(want))
                gs, ws = set(map(repr, got)), set(map(repr, want))
                for r in [g for g in map(repr, got) if g not in ws][:3]:
                    print("   got ", r[:300])
                for r in [w for w in map(repr, want) if w not in gs][:3]:
                    print("   want", r[:300])
        except Exception as exc:  # noqa: BLE001 - report and go on
            bad.append(name)
            print(f"FAIL  {name}: {str(exc)[:1500]}", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} good; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
