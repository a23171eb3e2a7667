"""The general operators against brute force, and on odd input: nulls, ties, repeats, no rows, clashing names."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quadflow.operators import hierarchy as H
from quadflow.operators import orphans as O
from quadflow.operators import pivot as P
from quadflow.operators import skew as S

UTC = dt.timezone.utc


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# hierarchies


def brute_tree(edges):
    parent = {}
    for f, c, p in edges:
        if c is not None and p is not None:
            parent[f, c] = min(p, parent.get((f, c), p))
    out = {}
    for f, n in {(f, c) for f, c in parent} | {(f, p) for (f, _), p in parent.items()}:
        path, x = [n], n
        while (f, x) in parent and parent[f, x] not in path:
            x = parent[f, x]
            path.append(x)
        if (f, x) in parent:
            loop = path[path.index(parent[f, x]) :]
            out[f, n] = (min(loop), -1, None)
        else:
            out[f, n] = (x, len(path) - 1, path[::-1])
    return out


def random_edges(seed, n=60):
    r = random.Random(seed)
    edges = [("a", i, r.randrange(max(1, i - 4), i)) for i in range(2, n) if r.random() < 0.93]
    edges += [("b", i, i + 1) for i in range(0, 25)]  # a chain
    edges += [("a", 100, 101), ("a", 101, 102), ("a", 102, 100), ("a", 103, 102), ("a", 104, 103), ("a", 110, 110), ("a", 111, 110), ("b", 7, 3)]
    return edges + edges[:10] + [("a", None, 1), ("a", 1, None), (None, 5, 6), (None, 6, 7)]


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_matches_brute_force(spark, seed):
    edges = random_edges(seed)
    df = spark.createDataFrame(edges, "family string, child bigint, parent bigint").withColumn("node_id", F.lit(1)).withColumn("depth", F.lit("x")).withColumn("level", F.lit(2))
    tree = H.hierarchy(df).cache()
    want = brute_tree(edges)
    assert {(r["family"], r["node_id"]): (r["root_id"], r["depth"], r["path"]) for r in tree.collect()} == want
    assert tree.count() == len(want)
    pairs = {(f, a, n, len(p) - 1 - i) for (f, n), (_, d, p) in want.items() if d > 0 for i, a in enumerate(p[:-1])}
    assert {tuple(r) for r in H.descendants(tree).collect()} == pairs


def brute_pairs(edges):
    parent = {}
    for f, c, p in edges:
        if c is not None and p is not None:
            parent[f, c] = min(p, parent.get((f, c), p))
    pairs = set()
    for f, n in parent:
        x, seen = n, {n}
        while (f, x) in parent and parent[f, x] not in seen:
            x = parent[f, x]
            pairs.add((f, x, n, len(seen)))
            seen.add(x)
    return pairs


@pytest.mark.parametrize("seed", [1, 2])
def test_all_descendants_match_brute_force(spark, seed):
    loop = [("c", i, (i + 1) % 37) for i in range(37)] + [("c", 100 + i, 99 + i if i else 5) for i in range(70)] + [(None, 1, 2), (None, 2, 1), (None, 3, 1)]
    edges = random_edges(seed) + loop
    got = [tuple(r) for r in H.all_descendants(H.hierarchy(spark.createDataFrame(edges, "family string, child bigint, parent bigint"))).select("family", "ancestor_id", "node_id", "distance").collect()]
    assert set(got) == brute_pairs(edges) and len(got) == len(set(got))
    assert ("a", 102, 104, 2) in got and ("a", 100, 104, 3) in got and (None, 2, 3, 2) in got


def test_all_descendants_of_trees_only_and_of_self_loops(spark):
    schema = "family string, child bigint, parent bigint"
    assert {tuple(r) for r in H.all_descendants(H.hierarchy(spark.createDataFrame([("f", 1, 2)], schema))).collect()} == {("f", 2, 1, 1)}
    assert H.all_descendants(H.hierarchy(spark.createDataFrame([("f", 1, 1)], schema))).count() == 0
    assert H.all_descendants(H.hierarchy(spark.createDataFrame([], schema))).count() == 0


def test_hierarchy_of_nothing_and_of_loops_only(spark):
    schema = "family string, child bigint, parent bigint"
    assert H.hierarchy(spark.createDataFrame([], schema)).count() == 0
    loop = [("f", i, (i + 1) % 37) for i in range(37)] + [("f", 100 + i, 99 + i if i else 5) for i in range(70)]
    got = H.hierarchy(spark.createDataFrame(loop, schema))
    assert {tuple(r) for r in got.select("root_id", "depth").collect()} == {(0, -1)} and got.count() == 107


def test_link_edges_skip_literals_and_other_predicates(spark):
    st = spark.createDataFrame([(1, 7, 0, 2), (1, 8, 0, 3), (4, 9, 0, 5), (1, 7, 1, 6), (None, 7, 0, 2), (1, 7, 0, None), (1, None, 0, 2), (1, 7, None, 2)], "subject bigint, predicate bigint, objecttype int, object bigint")
    pr = spark.createDataFrame([(7, "c", "up"), (7, "c", "up"), (9, "p", "down"), (8, None, None)], "predicate bigint, link_family string, link_direction string")
    assert rows(H.link_edges(st, pr), "family", "child", "parent") == [("c", 1, 2), ("p", 5, 4)]


# wide tables

PREDICATES = [(1, "n", "integer", True), (2, "n", "integer", True), (3, "d", "decimal", True), (4, "x", "double", True), (5, "b", "boolean", True), (6, "t", "date", True), (7, "names", "string", False), (8, None, None, None), (9, "s", "string", True)]
TEXTS = {
    10: ("5", 1), 11: (" +05\n", 1), 12: ("5.0", None), 13: ("-0", 0), 14: ("0", 0), 15: ("", None), 16: ("1e2", None), 17: ("\t7 ", 7), 18: ("9" * 30, int("9" * 30)), 19: (None, None), 20: ("x" * 50_000, None),
}


def _wide(spark, statements, literals):
    st = spark.createDataFrame(statements, "subject bigint, predicate bigint, objecttype int, object bigint").withColumn("column_name", F.lit("clash")).withColumn("value", F.lit("clash"))
    lit = spark.createDataFrame(literals, "id bigint, value string").withColumn("object", F.lit(1)).withColumn("predicate", F.lit(1))
    pr = spark.createDataFrame(PREDICATES, "predicate bigint, column_name string, column_type string, single_valued boolean").withColumn("subject", F.lit(1))
    return P.wide_table(P.cell_values(st, pr, lit), pr.where("column_name is not null").select("column_name", "column_type", "single_valued"))


def test_wide_table_cells(spark):
    lits = [(k, v[0]) for k, v in TEXTS.items()] + [(10, "5"), (30, "1.50"), (31, "+1.5"), (32, ".5"), (33, "5."), (34, "1E2"), (35, "100"), (36, "NaN"), (37, "-INF"), (38, "true"), (39, "1"), (40, "yes"), (41, "2024-02-29"), (42, "2023-02-29"), (43, "2024-2-9"), (44, " a "), (45, "a"), (46, "1f"), (None, "5")]
    st = [
        (1, 1, 1, 10), (1, 2, 1, 11), (1, 1, 1, 10), (2, 1, 1, 10), (2, 1, 1, 17), (3, 1, 1, 12), (4, 1, 0, 77), (5, 1, 1, 999), (6, 1, 1, 13), (6, 1, 1, 14), (7, 1, 1, 19), (8, 1, 1, 12), (8, 1, 1, 10), (9, 1, 1, 18), (10, 1, 1, 20),
        (1, 3, 1, 30), (1, 3, 1, 31), (2, 3, 1, 32), (3, 3, 1, 33), (4, 3, 1, 34), (1, 4, 1, 34), (1, 4, 1, 35), (2, 4, 1, 36), (3, 4, 1, 37), (4, 4, 1, 46), (1, 5, 1, 38), (1, 5, 1, 39), (2, 5, 1, 40), (1, 6, 1, 41), (2, 6, 1, 42), (3, 6, 1, 43),
        (1, 7, 1, 45), (1, 7, 1, 44), (1, 7, 1, 45), (2, 7, 0, 3), (1, 9, 1, 44), (2, 9, 1, 44), (2, 9, 1, 45), (3, 8, 1, 10), (None, 1, 1, 10), (1, None, 1, 10), (1, 1, None, 10), (1, 1, 1, None),
    ]
    wide = _wide(spark, st, lits).cache()
    by = {r["subject"]: r for r in wide.collect()}
    assert sorted(by) == [1, 2, 3, 4, 6, 7, 8, 9, 10] and len(by) == wide.count()
    assert (by[1]["n"], by[1]["n__state"], by[1]["d"], by[1]["x"], by[1]["b"], str(by[1]["t"]), by[1]["names"], by[1]["s"]) == (5, "ok", 1.5, 100.0, True, "2024-02-29", [" a ", "a"], " a ")
    assert by[6]["n"] == 0 and by[8]["n"] == 5 and by[9]["n"] == int("9" * 30) and float(by[2]["d"]) == 0.5 and float(by[3]["d"]) == 5 and str(by[2]["x"]) == "nan" and by[3]["x"] == float("-inf")
    want = {(2, "n", "conflict"), (3, "n", "unreadable"), (4, "n", "unreadable"), (7, "n", "unreadable"), (10, "n", "unreadable"), (4, "d", "unreadable"), (4, "x", "unreadable"), (2, "b", "unreadable"), (2, "t", "unreadable"), (3, "t", "unreadable"), (2, "s", "conflict")}
    assert {tuple(r) for r in P.unfilled(wide).collect()} == want


def test_wide_table_loses_no_digit(spark):
    lits = [(10, "0.12345678901234567"), (11, "9" * 40), (12, "0." + "1" * 19), (13, "-00012345678901234567890.5")]
    by = {r["subject"]: r for r in _wide(spark, [(1, 3, 1, 10), (2, 1, 1, 11), (3, 3, 1, 12), (4, 3, 1, 13), (5, 3, 1, 11)], lits).collect()}
    assert str(by[1]["d"]).rstrip("0") == "0.12345678901234567" and by[1]["d__state"] == "ok" and by[1]["d__exact"] is None
    assert (by[2]["n"], by[2]["n__state"], by[2]["n__exact"]) == (None, "inexact", "9" * 40)
    assert (by[3]["d"], by[3]["d__state"], by[3]["d__exact"]) == (None, "inexact", "0." + "1" * 19)
    assert str(by[4]["d"]).rstrip("0") == "-12345678901234567890.5" and by[5]["d__exact"] == "9" * 40


def test_wide_table_of_nothing_and_of_a_hot_subject(spark):
    assert _wide(spark, [], []).count() == 0
    hot = _wide(spark, [(1, 1 + i % 2, 1, 10 + i % 2) for i in range(3000)] + [(i, 1, 1, 10) for i in range(2, 50)], [(10, "5"), (11, "6")])
    assert {tuple(r) for r in P.unfilled(hot).collect()} == {(1, "n", "conflict")} and hot.count() == 49


# orphans


def _at(h):
    return None if h is None else dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(hours=h)


def test_orphans_match_brute_force(spark):
    r = random.Random(6)
    spans = defaultdict(list)
    ent, lit, bn = [], [], []
    for i in range(40):
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            a = r.choice([None, r.randrange(2000)]) if r.random() < 0.1 else r.randrange(2000)
            u = None if a is None or r.random() < 0.5 else a + r.randrange(1, 500)
            which = r.choice("elb")
            (ent if which == "e" else lit if which == "l" else bn).append((i, _at(a)) + (() if which == "b" else (_at(u),)))
            spans["literal" if which == "l" else "resource", i].append((a, u if which != "b" else None))
    ent += ent[:5]
    st = [(k, r.randrange(45) if r.random() < 0.6 else 3, r.choice([0, 1]), r.choice([None, r.randrange(45)]), None if r.random() < 0.05 else r.randrange(2500)) for k in range(900)] + [(5000, 1, None, 2, 10), (5001, None, 0, None, 10)]
    want = set()
    for k, s, kind, o, at in st:
        for side, t, key in (("subject", "resource", s), ("object", {0: "resource", 1: "literal"}.get(kind), o)):
            if key is None or t is None:
                continue
            mine = spans[t, key]
            if not mine:
                want.add((k, side, "missing"))
            elif at is not None and not any(a is not None and a <= at and (u is None or at < u) for a, u in mine):
                want.add((k, side, "deleted" if any(a is not None and a <= at for a, _ in mine) else "late"))
    s3 = "id bigint, added_at timestamp, removed_at timestamp"
    frames = [spark.createDataFrame(ent, s3), spark.createDataFrame(bn, "id bigint, added_at timestamp"), spark.createDataFrame(lit, s3)]
    frames = [f.withColumn("key", F.lit(1)).withColumn("parent", F.lit(1)) for f in frames]
    statements = spark.createDataFrame([(*x[:4], _at(x[4])) for x in st], "stmt_id bigint, subject bigint, objecttype int, object bigint, added_at timestamp").withColumn("side", F.lit("clash")).withColumn("key", F.lit(1))
    cases = O.orphans(O.spans(*frames), O.references(statements)).cache()
    assert {tuple(x) for x in cases.select("stmt_id", "side", "state").collect()} == want and cases.count() == len(want)
    assert {s for _, _, s in want} == {"missing", "deleted", "late"}
    report = O.orphan_report(cases)
    assert report.agg(F.sum("n_refs")).first()[0] == len(want)
    assert O.orphans(O.spans(*[f.limit(0) for f in frames]), O.references(statements.limit(0))).count() == 0
    assert O.orphans(O.spans(*[f.limit(0) for f in frames]), O.references(statements)).where("state <> 'missing'").count() == 0


# skew


@pytest.mark.parametrize("n", [1, 3, 17])  # many partitions split the hot key and single rows
def test_key_stats_match_brute_force(spark, n):
    r = random.Random(8)
    data = [(k, 7 if r.random() < 0.4 else r.choice([None, 1, 2, 3]), r.randrange(4), None if r.random() < 0.1 else _at(r.randrange(300))) for k in range(700)]
    data += data[:20]
    df = spark.createDataFrame(data, "stmt_id bigint, predicate bigint, meta bigint, added_at timestamp").withColumn("us", F.lit("clash")).withColumn("key_id", F.lit(1))
    want = {}
    for f, at in (("predicate", 1), ("meta", 2)):
        by = defaultdict(list)
        for x in data:
            by[x[at]].append(x[3])
        for key, times in by.items():
            ts = sorted(int(t.timestamp() * 1e6) for t in times if t)
            want[f, key] = (len(times), ts[0] if ts else None, ts[-1] if ts else None, max((b - a for a, b in zip(ts, ts[1:])), default=None))
    stats = S.key_stats(S.key_rows(df, ["predicate", "meta"], "added_at", "stmt_id"), n)
    assert {(x["field_name"], x["key_id"]): tuple(x)[2:] for x in stats.collect()} == want
    heavy = {(f, k) for (f, k), v in want.items() if k is not None and v[0] >= 0.05 * len(data)}
    assert {tuple(x) for x in S.heavy_keys(stats, len(data)).collect()} == heavy


def test_partials_are_few_and_even(spark):
    df = spark.range(20_000).select(F.col("id").alias("stmt_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("predicate"), F.timestamp_seconds("id").alias("added_at"))
    keyed = S.key_rows(df, ["predicate"], "added_at", "stmt_id")
    parts = Counter()
    for x in S.key_partials(keyed, 8).collect():
        parts[x["part"]] += x["n"]
    assert len(parts) == 8 and max(parts.values()) < 2 * 20_000 / 8  # though one key has a third of all rows
    assert S.key_stats(keyed.limit(0)).count() == 0
    assert S.heavy_keys(S.key_stats(keyed.limit(0)), 0).count() == 0
