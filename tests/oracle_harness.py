"""Run registered queries on Spark and their SQL on DuckDB; compare.

Comparison in the driver's spirit: row count, column names (sorted), column
types (Spark's against DuckDB's) and an order-insensitive multiset of rows.  Doubles are compared exactly and,
separately, after rounding to 9 significant digits, so a report says
whether a mismatch is real or last-bit noise.

    python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits: int | None):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if digits is not None and v != 0 and not math.isinf(v):
            return float(f"{v:.{digits}g}")
        return v
    if isinstance(v, decimal.Decimal):
        return _norm(float(v), digits)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    return v


def _rows(cols, rows, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i], digits) for i in order) for r in rows)


# Spark type name -> DuckDB result type name
TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
              "timestamp": "TIMESTAMP WITH TIME ZONE"}


def type_mismatches(df, con, sql: str) -> list:
    want = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [(c, t, want.get(c)) for c, t in df.dtypes if TYPE_NAMES.get(t, t) != want.get(c)]


def spark_rows(df):
    cols = df.columns
    out = []
    for r in df.collect():
        vals = []
        for v in r:
            if hasattr(v, "asDict"):
                v = v.asDict(recursive=True)
            vals.append(v)
        out.append(vals)
    return cols, out


def compare(spark, con, name: str, sf_dir: str, queries, sql) -> dict:
    t0 = time.time()
    df = queries[name](spark, sf_dir)
    scols, srows = spark_rows(df)
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if name not in sql:
        res["status"] = "rows-only"
        return res
    cur = con.execute(sql[name])
    ocols = [d[0] for d in cur.description]
    orows = [list(r) for r in cur.fetchall()]
    res["oracle_rows"] = len(orows)
    if sorted(scols) != sorted(ocols):
        res["status"] = f"COLUMNS {sorted(scols)} vs {sorted(ocols)}"
        return res
    if len(srows) != len(orows):
        res["status"] = "ROWCOUNT"
        return res
    bad_types = type_mismatches(df, con, sql[name])
    if bad_types:
        res["status"] = f"TYPES {bad_types}"
        return res
    if _rows(scols, srows, None) == _rows(ocols, orows, None):
        res["status"] = "exact"
    elif _rows(scols, srows, 9) == _rows(ocols, orows, 9):
        res["status"] = "approx"
    else:
        a, b = _rows(scols, srows, 9), _rows(ocols, orows, 9)
        res["status"] = "VALUES"
        res["spark_only"] = list((a - b).elements())[:3]
        res["oracle_only"] = list((b - a).elements())[:3]
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from ledgerlens.oracle_sql import SQL
    from ledgerlens.plans.registry import QUERIES
    from ledgerlens.session import build_session
    names = argv[2:] or list(QUERIES)
    spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir, QUERIES, SQL)
        except Exception as e:  # report and continue
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("exact", "approx", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
