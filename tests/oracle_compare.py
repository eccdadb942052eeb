"""Compare catalogue queries with their DuckDB oracle on the driver tables.

Usable from pytest and as a script::

    python tests/oracle_compare.py /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


SPARK_TO_DUCK = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "date": "DATE", "boolean": "BOOLEAN",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, _dt.datetime):
        return v.date().isoformat() if v.time() == _dt.time() else v.isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", x if x is not None else 0) for x in row)


def _rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in data]
    return [cols[i] for i in order], sorted(rows, key=lambda r: repr(r))


def _close(a, b, tol):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return math.isclose(float(a), float(b), rel_tol=tol, abs_tol=tol)
    return a == b


def compare(spark, sf_dir: str, key: str, fn, sql: str, con=None) -> dict:
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = list(sdf.columns)
    s_data = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_data = res.fetchall()
    out = {"key": key, "spark_rows": len(s_data), "oracle_rows": len(d_data), "spark_sec": round(t1 - t0, 3)}
    sc, sr = _rows(s_cols, s_data)
    dc, dr = _rows(d_cols, d_data)
    out["columns_match"] = sc == dc
    rel = con.sql(sql)
    d_types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    s_types = {n: SPARK_TO_DUCK.get(t, t) for n, t in sdf.dtypes}
    out["types_match"] = s_types == d_types
    if not out["types_match"]:
        out["type_diff"] = {c: (s_types.get(c), d_types.get(c)) for c in set(s_types) | set(d_types)
                            if s_types.get(c) != d_types.get(c)}
    if sc != dc:
        out["spark_columns"], out["oracle_columns"] = sc, dc
    out["exact"] = sr == dr
    if not out["exact"] and len(sr) == len(dr) and sc == dc:
        out["tolerant"] = all(all(_close(a, b, 1e-9) for a, b in zip(x, y)) for x, y in zip(sr, dr))
        diffs = [(x, y) for x, y in zip(sr, dr) if x != y][:3]
        out["diff_sample"] = diffs
    return out


def main(argv):
    from firmscope.session import build_session
    from firmscope.plans import catalog

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    q, sql = catalog.queries(), catalog.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for k in keys or sorted(q):
        if k not in sql:
            t0 = time.time()
            n = q[k](spark, sf_dir).count()
            print(f"{k:28s} rows-only {n} ({time.time() - t0:.2f}s)")
            continue
        try:
            r = compare(spark, sf_dir, k, q[k], sql[k], con)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{k:28s} ERROR {type(e).__name__}: {str(e)[:400]}")
            continue
        ok = r["exact"] and r["columns_match"] and r["types_match"] and r["spark_rows"] == r["oracle_rows"]
        bad += not ok
        print(f"{k:28s} {'OK ' if ok else 'BAD'} {r}" if not ok else f"{k:28s} OK  rows={r['spark_rows']} {r['spark_sec']}s")
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
