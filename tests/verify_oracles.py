"""Run registered queries and their oracle SQL side by side: python tests/verify_oracles.py [sf_dir] [name-prefix...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return str(v).replace("T", " ").removesuffix(" 00:00:00")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    try:
        import decimal

        if isinstance(v, decimal.Decimal):
            return round(float(v), 6)
    except ImportError:
        pass
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([norm(r[i]) for i in order] for r in rows), key=repr)


def same(a, b):
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            if p != q and not (isinstance(p, (int, float)) and isinstance(q, (int, float)) and not isinstance(p, bool) and math.isclose(p, q, rel_tol=1e-9, abs_tol=2e-6)):
                return f"{x} against {y}"
    return ""


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"{len(got)} rows, no oracle"
    rel = con.sql(sql)
    if sorted(rel.columns) != sorted(df.columns):
        return f"MISMATCH columns {sorted(df.columns)} {sorted(rel.columns)}"
    bad = same(got, rows_of(rel.columns, rel.fetchall()))
    return f"MISMATCH {bad[:600]}" if bad else f"ok {len(got)}"


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main(args):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    oracle = e.oracle_sql()
    skip = [n[1:] for n in names if n.startswith("~")]
    names = [n for n in names if not n.startswith("~")]
    for name, q in e.queries().items():
        if any(name.startswith(s) for s in skip):
            continue
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            said = compare(spark, con, name, q, oracle.get(name), sf_dir)
        except Exception as x:
            said = f"ERROR {str(x)[:1500]}"
        bad += said.startswith(("ERROR", "MISMATCH"))
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
