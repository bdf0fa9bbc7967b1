"""Run registered queries in Spark and their oracle SQL in DuckDB; compare
row count, column names and the multiset of rows (columns sorted by name).

    python tests/oracle_compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, key, sf_dir, fn, sql, con):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(key=key, ok=None, rows=len(srows), spark_s=round(t1 - t0, 2))
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    info = dict(key=key, spark_rows=len(srows), duck_rows=len(drows),
                spark_s=round(t1 - t0, 2), duck_s=round(t2 - t1, 2))
    if sorted(scols) != sorted(dcols):
        info.update(ok=False, why=f"columns {sorted(scols)} vs {sorted(dcols)}")
        return info
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        info.update(ok=False, why=f"values differ, e.g. {diff}")
        return info
    info["ok"] = True
    return info


def main(argv):
    vanilla = "--vanilla" in argv
    argv = [a for a in argv if a != "--vanilla"]
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as E
    if vanilla:   # a plain session, as an outside caller would build it
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]")
                 .config("spark.sql.shuffle.partitions", "8")
                 .config("spark.ui.enabled", "false").getOrCreate())
    else:
        from feedlens.session import build_session
        spark = build_session("local[8]", 8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for k in keys or list(qs):
        try:
            info = compare(spark, k, sf_dir, qs[k], sqls.get(k), con)
        except Exception as e:  # noqa: BLE001
            info = dict(key=k, ok=False, why=f"{type(e).__name__}: {str(e)[:400]}")
        bad += info.get("ok") is False
        print(info, flush=True)
    print("FAILED", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
