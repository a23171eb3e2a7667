"""python tests/compare.py [SF_DIR] NAME...: runs queries and their SQL side by side."""

import hashlib
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as e

TABLES = "region nation customer supplier part orders lineitem events documents embeddings rdf_statements rdf_entities rdf_literals rdf_bnodes rdf_loads rdf_predicates page_labels subject_areas pack_limits mix_targets".split()


def cell(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list):
        return "[" + ",".join(map(cell, v)) + "]"
    if hasattr(v, "replace") and hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(cell(r[i]) for i in order) for r in rows)


def main():
    sf = sys.argv[1]
    q = e.queries()
    names = [n for n in q if any(n.startswith(x) for x in sys.argv[2:])] or list(q)
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")

    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    sql, bad = e.oracle_sql(), 0
    for n in names:
        t = time.time()
        try:
            df = q[n](spark, sf)
            got = rows_of(df.columns, df.collect())
        except Exception as x:
            print(n, "SPARK ERROR", str(x)[:1500], flush=True)
            bad += 1
            continue
        took = time.time() - t
        if n not in sql:
            print(f"{n}: {len(got)} rows, no SQL, {took:.1f} s", got[:2], flush=True)
            continue
        try:
            cur = con.execute(sql[n])
            cols = [d[0] for d in cur.description]
            want = rows_of(cols, cur.fetchall())
        except Exception as x:
            print(n, "SQL ERROR", str(x)[:600], flush=True)
            bad += 1
            continue
        same = got == want and sorted(cols) == sorted(df.columns)
        bad += not same
        print(f"{n}: {len(got)} rows, {took:.1f} s, {'same' if same else 'DIFFERS'} {hashlib.md5(chr(10).join(got).encode()).hexdigest()[:6]}", flush=True)
        if not same:
            g, w = set(got), set(want)
            print("   only spark", len(g - w), list(g - w)[:3], "\n   only sql", len(w - g), list(w - g)[:3], sorted(df.columns), sorted(cols), len(want), flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
