"""Run registered queries against their DuckDB oracle (what the driver's
correctness gate does): row count, column names, column kinds, and an
order-insensitive comparison of all values.

    python tests/oracle_check.py [name ...] [--sf /root/testdata/sf0.01]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    try:
        import pandas as pd

        if v is pd.NaT:
            return "NULL"
    except Exception:  # pragma: no cover
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        s = v.isoformat()
        return s.replace("T00:00:00", "") if len(s) == 19 and s.endswith("T00:00:00") else s
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return str(v)


def _kind(t: str) -> str:
    t = t.lower()
    for k, names in {
        "int": ("bigint", "int64", "long"),
        "int32": ("integer", "int32", "int"),
        "float": ("double", "float", "decimal"),
        "bool": ("bool",),
        "str": ("varchar", "string", "str"),
        "date": ("date",),
        "ts": ("timestamp",),
    }.items():
        if any(t.startswith(n) for n in names):
            return k
    return t


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from __spark_entry__ import oracle_sql, queries

    q = queries()[name]
    sql = oracle_sql().get(name)
    t0 = time.time()
    sdf = q(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    stypes = [t for _, t in sdf.dtypes]
    t1 = time.time()
    out = {"name": name, "rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    rel = con.sql(sql)
    ocols = rel.columns
    otypes = [str(t) for t in rel.types]
    orows = rel.fetchall()
    out["oracle_rows"] = len(orows)
    if sorted(scols) != sorted(ocols):
        out["status"] = f"COLUMNS spark={sorted(scols)} oracle={sorted(ocols)}"
        return out
    sk = {c: _kind(t) for c, t in zip(scols, stypes)}
    ok = {c: _kind(t) for c, t in zip(ocols, otypes)}
    kinds = [c for c in scols if sk[c] != ok[c]]
    si = [scols.index(c) for c in sorted(scols)]
    oi = [ocols.index(c) for c in sorted(ocols)]
    sn = sorted("|".join(_norm(r[i]) for i in si) for r in srows)
    on = sorted("|".join(_norm(r[i]) for i in oi) for r in orows)
    if len(sn) != len(on):
        out["status"] = f"ROWCOUNT spark={len(sn)} oracle={len(on)}"
    elif sn != on:
        diff = [(a, b) for a, b in zip(sn, on) if a != b][:3]
        out["status"] = f"VALUES {sorted(scols)} first diffs: {diff}"
    else:
        out["status"] = "ok"
    if kinds:
        out["status"] += "  KIND " + ", ".join(f"{c}:{sk[c]}/{ok[c]}" for c in kinds)
    return out


def main(argv: list[str]) -> int:
    sf = "/root/testdata/sf0.01"
    names = []
    it = iter(argv)
    for a in it:
        if a == "--sf":
            sf = next(it)
        else:
            names.append(a)
    from aircast.session import build_session
    from __spark_entry__ import queries

    spark = build_session()
    con = duck(sf)
    bad = 0
    for n in names or list(queries()):
        try:
            r = compare(spark, n, sf, con)
        except Exception as e:  # report and go on
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if not r["status"].startswith(("ok", "rows-only")) or "KIND" in r["status"]:
            bad += 1
        print(f"{r['status'][:600]:<10} {n} rows={r.get('rows')} t={r.get('spark_sec')}", flush=True)
    print(f"{bad} problem(s)")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
