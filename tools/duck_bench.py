"""Time each oracle SQL on DuckDB over the driver tables (the single-node reference point).

    python tools/duck_bench.py [--sf /root/testdata/sf0.1] [--timeout 300] [key ...]
Prints one JSON line {key: seconds or null (timed out)}.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from rejoinder.plans.oracle import ORACLE  # noqa: E402
from rejoinder.sources.tables import TABLES  # noqa: E402


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--timeout", type=float, default=300)
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    out = {}
    for k in a.keys or sorted(ORACLE):
        timer = threading.Timer(a.timeout, con.interrupt)
        timer.start()
        t0 = time.time()
        try:
            con.sql(ORACLE[k]).fetchall()
            out[k] = round(time.time() - t0, 3)
        except Exception:  # noqa: BLE001  (interrupted)
            out[k] = None
        finally:
            timer.cancel()
        print(f"# {k}: {out[k]}", file=sys.stderr, flush=True)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
