"""Queries over all of the store, on the smallest tables: minimal graphs by brute force, rule paths beside their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quadflow.sources.mapping import rdf_store
from tests.compare import rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_msg_store_covers_every_statement(spark):
    quads = [tuple(r) for r in rdf_store(spark, SF).quads.select("s", "p", "o", "g").collect()]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for s, _, o, _ in quads:
        blank = [x for x in (s, o) if x.startswith("_:")]
        a, b = (find(x) for x in (blank * 2)[:2]) if blank else (None, None)
        if blank and a != b:
            root[max(a, b)] = min(a, b)
    want = sorted((s, p, o, g, next((find(x) for x in (s, o) if x.startswith("_:")), "")) for s, p, o, g in quads)
    got = sorted((r["s"], r["p"], r["o"], r["g"], r["msg"] or "") for r in entry.queries()["msg_store"](spark, SF).collect())
    assert got == want and any(m for *_, m in want) and any(not m for *_, m in want)


def test_rule_path_links_gives_what_its_sql_gives(spark):
    con = duckdb.connect()
    for t in ("rdf_statements", "rdf_predicates"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()["rule_path_links"](spark, SF)
    cursor = con.execute(entry.oracle_sql()["rule_path_links"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())
