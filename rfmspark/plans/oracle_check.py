"""Local twin of the driver's correctness gate: run a registered query on Spark and its
SQL on DuckDB over the same Parquet tables, compare row count, column names and
an order-insensitive digest of the values.

    python -m rfmspark.plans.oracle_check /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time


def _norm(v):
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def duck(sf_dir: str):
    import duckdb
    from rfmspark.sources.tables import TABLES
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(spark, sf_dir: str, names=None, verbose=True):
    import importlib
    entry = importlib.import_module("__spark_entry__")
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sp = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:400]}"
            print(name, results[name], flush=True)
            continue
        t1 = time.time()
        if name not in sqls:
            results[name] = f"rows-only ({len(sp)} rows)"
            print(f"{name:32s} {results[name]} spark {t1 - t0:.1f}s", flush=True)
            continue
        try:
            dk = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            results[name] = f"SQL ERROR {str(e)[:400]}"
            print(name, results[name], flush=True)
            continue
        sc, sr = _rows(sp)
        dc, dr = _rows(dk)
        if sc != dc:
            status = f"COLUMNS differ spark={sc} sql={dc}"
        elif len(sr) != len(dr):
            status = f"ROWCOUNT differ spark={len(sr)} sql={len(dr)}"
        elif sr != dr:
            bad = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
            status = f"VALUES differ e.g. {bad}"
        else:
            status = "OK"
        results[name] = status
        print(f"{name:32s} {status} ({len(sr)} rows) spark {t1 - t0:.1f}s", flush=True)
    return results


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from rfmspark.session import build_session
    sp = build_session()
    res = check(sp, sys.argv[1], sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if not (v == "OK" or v.startswith("rows-only"))}
    print(f"{len(res) - len(bad)}/{len(res)} ok")
    for k, v in bad.items():
        print("FAIL", k, v)
