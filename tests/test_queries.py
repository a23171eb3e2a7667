"""Registered queries beside their SQL on the smallest tables; tests/compare.py does it for all and for larger ones."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
NAMES = ["bgp_three_hop", "optional_shared", "union_unbound", "filter_or_error", "order_limit_offset", "graph_var", "construct_names", "rdf_optional", "rdfs_store_classes", "rule_math_remainder", "io_turtle_pages", "io_rdfxml", "http_endpoint_join", "rules_all_proofs", "own_sink", "rdf_two_hop", "p1_paths", "p2_found", "p2_wide_text", "p6_report", "p7_stats"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("the tables are not here")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())
