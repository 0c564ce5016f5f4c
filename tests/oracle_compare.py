"""Run registered queries in Spark and their oracle SQL in DuckDB, compare results.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Prints one line per query: name, status, rows (spark / oracle).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir: str, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", repr(e)[:300])
            if verbose:
                print(f"{name:40s} SPARK_ERROR {repr(e)[:300]}", flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = ("ROWS_ONLY", len(srows))
            if verbose:
                print(f"{name:40s} ROWS_ONLY rows={len(srows)} {ts:.1f}s", flush=True)
            continue
        try:
            rel = con.execute(sqls[name])
            ocols = [d[0] for d in rel.description]
            orows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("SQL_ERROR", repr(e)[:300])
            if verbose:
                print(f"{name:40s} SQL_ERROR {repr(e)[:300]}", flush=True)
            continue
        if sorted(scols) != sorted(ocols):
            status = f"COLUMNS spark={sorted(scols)} oracle={sorted(ocols)}"
        elif len(srows) != len(orows):
            status = f"ROWCOUNT spark={len(srows)} oracle={len(orows)}"
        else:
            a, b = _rows(scols, srows), _rows(ocols, orows)
            if a == b:
                status = "MATCH"
            else:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                status = f"VALUES {diff}"
        results[name] = (status.split()[0], len(srows))
        if verbose:
            print(f"{name:40s} {status[:600]} rows={len(srows)} {ts:.1f}s", flush=True)
    return results


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:] or None
    from binscope.session import get_session
    spark = get_session("local[8]", 8)
    res = compare(spark, sf, only)
    bad = {k: v for k, v in res.items() if v[0] not in ("MATCH", "ROWS_ONLY")}
    print("SUMMARY", len(res), "queries,", len(bad), "not matching:", sorted(bad))
