"""Blank-node subgraphs: minimal self-contained graphs, lean graphs, isomorphism, connectivity."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadflow.runtime import small, written, written_counted

KEYS = ["s", "p", "o", "g"]


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node each node (of column node) is connected with over edges (a, b).

    Alternating large and small stars: each node links its larger neighbours, then its smaller ones, to the smallest.
    Rounds grow with the logarithm of the longest chain, and no node gathers its neighbours in one row.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(small_least, "u")
        linked = step.select("u", F.col("m").alias("v")).unionByName(step.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        links = written(linked, "links")
        now = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return nodes.select("node").distinct().join(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def msgs(quads: DataFrame) -> DataFrame:
    """The quads with msg: the smallest blank node connected with the statement's, or, for one without any, null.

    A minimal self-contained graph is all statements of one msg; each statement without blank nodes is one by itself.
    """
    blank = lambda c: F.when(F.col(c).startswith("_:"), F.col(c))
    q = quads.withColumns({"_s": blank("s"), "_o": blank("o")})
    nodes = q.select(F.explode(F.array("_s", "_o")).alias("node")).where("node is not null")
    found = components(q.where("_s is not null and _o is not null").select(F.col("_s").alias("a"), F.col("_o").alias("b")), nodes)
    return q.withColumn("node", F.coalesce("_s", "_o")).join(found, "node", "left").withColumnRenamed("component", "msg").drop("node", "_s", "_o")


def find_msg(quads: DataFrame, node: str) -> DataFrame:
    """The statements reached from a blank node over statements that share blank nodes."""
    spark = quads.sparkSession
    front = spark.createDataFrame([(node,)], "node string")
    seen = front
    while True:
        hit = quads.join(small(front.withColumnRenamed("node", "s")), "s", "left_semi").select(*KEYS).unionByName(quads.join(small(front.withColumnRenamed("node", "o")), "o", "left_semi").select(*KEYS))
        near = hit.select(F.explode(F.array("s", "o")).alias("node")).where(F.col("node").startswith("_:")).distinct()
        front = written(near.join(seen, "node", "left_anti"), "front")
        if front.isEmpty():
            break
        seen = written(seen.unionByName(front), "seen")
    by_s = quads.join(small(seen.withColumnRenamed("node", "s")), "s", "left_semi")
    return by_s.unionByName(quads.join(small(seen.withColumnRenamed("node", "o")), "o", "left_semi").select(*quads.columns)).dropDuplicates(KEYS)


Quad = tuple[str, str, str, str]
#: Begins the labels of blank nodes of what a graph is made lean relative to.
THEIRS = "_:!"


def canonical_labels(statements: list[Quad], rounds: int | None = None) -> dict[str, str]:
    """A hash per blank node that depends on the graph around it and not on labels: colour refinement until a round
    parts no more nodes, or for so many rounds. Nodes of one hash may still differ."""
    nodes = {x for s in statements for x in (s[0], s[2]) if x.startswith("_:")}
    colour = dict.fromkeys(nodes, "_")
    about = defaultdict(list)
    for s in statements:
        for x in {s[0], s[2]} & nodes:
            about[x].append(s)
    parted = 0
    for _ in range(len(nodes) + 1 if rounds is None else min(rounds, len(nodes) + 1)):
        def seen(x: str, me: str) -> str:
            return "*" if x == me else colour.get(x, x)

        colour = {n: hashlib.sha1("\n".join(sorted("\t".join((seen(s[0], n), s[1], seen(s[2], n), s[3])) for s in about[n])).encode()).hexdigest() for n in nodes}
        if rounds is None and len(set(colour.values())) == parted:
            break
        parted = len(set(colour.values()))
    return colour


def mapping(pattern: list[Quad], target: list[Quad], free: set[str], injective: bool = False, banned: frozenset[Quad] = frozenset()) -> dict[str, str] | None:
    """Terms for the free blank nodes of a pattern under which all its statements are in the target, by backtracking."""
    by_p = defaultdict(list)
    for t in target:
        if t not in banned:
            by_p[t[1], t[3]].append(t)
    often = Counter(k for ts in by_p.values() for t in ts for k in ((t[0], t[1], None, t[3]), (None, t[1], t[2], t[3])))
    rare = lambda t: often[None, t[1], t[2], t[3]] if t[2] not in free else often[t[0], t[1], None, t[3]] if t[0] not in free else len(by_p[t[1], t[3]])
    order, seen, left = [], set(), list(pattern)
    while left:  # the statements with the fewest open nodes first, of these what hangs on placed nodes, then the rarest
        best = min(left, key=lambda t: (sum(x in free and x not in seen for x in (t[0], t[2])), t[0] not in seen and t[2] not in seen, rare(t)))
        left.remove(best)
        order.append(best)
        seen |= {x for x in (best[0], best[2]) if x in free}

    def extended(i: int, m: dict[str, str]) -> Iterator[dict[str, str]]:
        s, p, o, g = order[i]
        for t in by_p[p, g]:
            new = dict(m)
            for x, y in ((s, t[0]), (o, t[2])):
                want = new.get(x, x) if x in free else x
                if x in free and x not in new:
                    if injective and (y in new.values() or not y.startswith("_:")):
                        break
                    new[x] = y
                elif want != y:
                    break
            else:
                yield new

    if not order:
        return {}
    stack = [extended(0, {})]  # not by recursion: a graph may have more statements than Python has frames
    while stack:
        m = next(stack[-1], None)
        if m is None:
            stack.pop()
        elif len(stack) == len(order):
            return m
        else:
            stack.append(extended(len(stack), m))
    return None


def isomorphic(a: list[Quad], b: list[Quad]) -> bool:
    """Whether two graphs are the same but for blank node labels."""
    a, b = list(set(a)), list(set(b))
    if len(a) != len(b):
        return False
    ca, cb = canonical_labels(a), canonical_labels(b)
    if Counter(ca.values()) != Counter(cb.values()):
        return False
    marked = lambda x, c: [*x, *[(n, "colour", h, "") for n, h in c.items()]]
    return mapping(marked(a, ca), marked(b, cb), set(ca), injective=True) is not None


def retract(statements: list[Quad]) -> list[Quad]:
    """The smallest part of a graph that the whole maps into: redundant blank nodes are folded away."""
    now = sorted(set(statements))
    changed = True
    while changed:
        changed = False
        for n in sorted({x for s in now for x in (s[0], s[2]) if x.startswith("_:")}):
            without = [s for s in now if n not in (s[0], s[2])]
            free = {x for s in now for x in (s[0], s[2]) if x.startswith("_:")}
            if mapping(now, without, free) is not None:
                now, changed = without, True
                break
    return now


def _unlike(folded: DataFrame) -> DataFrame:
    """(msg): one graph of those that are the same but for labels; folded: statements with msg, shape and told.

    Where all nodes of a graph have colours of their own (told), one shape is one graph. Else each is compared with the
    smallest of its shape, and those that prove unlike with the smallest of them, until none is left.
    """
    alike = F.udf(lambda a, b: isomorphic([tuple(x) for x in a], [tuple(x) for x in b]), "boolean")
    told = folded.where("told").groupBy("shape").agg(F.min("msg").alias("msg")).select("msg")
    left, count = written_counted(folded.where("not told").groupBy("shape", "msg").agg(F.collect_list(F.struct(*KEYS)).alias("graph")), "graphs")
    kept = [told]
    while count:
        first = left.groupBy("shape").agg(F.min_by(F.struct("msg", "graph"), "msg").alias("first"))
        kept.append(first.select("first.msg"))
        rest = left.join(first, "shape").where("msg <> first.msg")
        left, count = written_counted(rest.where(~alike("graph", "first.graph")).select("shape", "msg", "graph"), "graphs")
    return reduce(DataFrame.unionByName, kept)


def make_lean(quads: DataFrame, relative_to: DataFrame | None = None) -> DataFrame:
    """The quads without blank-node subgraphs that say nothing the rest does not say.

    First each minimal self-contained graph is folded by itself, one per group of a Python task. Then whole ones that
    another one or ground statements cover are dropped: of those alike but for labels one stays, and one with a
    single blank node goes if another node has all of its statements, found by a join on its rarest statement. Larger
    ones that only map into others not alike are kept. relative_to: further quads that count as there already, in blank
    nodes of their own; what they cover goes too, none of theirs is in the result.
    """
    columns = ["s", "p", "o", "g", "o_kind", "o_val", "o_lang", "o_dt"]
    mine = quads.select(*columns).dropDuplicates(KEYS)
    theirs = None
    if relative_to is not None:  # their labels come first in order, so of graphs that say the same theirs is the one that stays
        other = lambda c: F.when(F.col(c).startswith("_:"), F.concat(F.lit(THEIRS), F.col(c).substr(F.lit(3), F.length(c)))).otherwise(F.col(c)).alias(c)
        theirs = relative_to.select(other("s"), "p", other("o"), "g", "o_kind", "o_val", "o_lang", "o_dt").dropDuplicates(KEYS)
    q = written(msgs(mine if theirs is None else mine.unionByName(theirs).dropDuplicates(KEYS)), "msgs")
    ground = q.where("msg is null").select(*columns)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = set(retract(list(pdf[KEYS].itertuples(index=False, name=None))))
        out = pdf[[t in kept for t in pdf[KEYS].itertuples(index=False, name=None)]].copy()
        rows = list(out[KEYS].itertuples(index=False, name=None))
        c = canonical_labels(rows)
        out["shape"] = hashlib.sha1("\n".join([str(len(c)), *sorted("\t".join((c.get(s, s), p, c.get(o, o), g)) for s, p, o, g in rows)]).encode()).hexdigest()
        out["n_nodes"] = len(c)
        out["told"] = len(set(c.values())) == len(c)
        return out

    schema = ", ".join(f"{c} string" for c in [*columns, "msg", "shape"]) + ", n_nodes int, told boolean"
    folded = written(q.where("msg is not null").select(*columns, "msg").groupBy("msg").applyInPandas(lambda p: fold(p)[[*columns, "msg", "shape", "n_nodes", "told"]], schema), "folded")
    one_each = written(folded.join(_unlike(folded), "msg", "left_semi"), "lean")
    single = one_each.where("n_nodes = 1")
    side = lambda df, n, x: df.select(F.col(n).alias("node"), F.concat_ws("\x1f", F.lit(n), F.col("p"), F.col(x), F.col("g")).alias("edge"))
    edges = side(single.where("not startswith(o, '_:')"), "s", "o").unionByName(side(single.where("not startswith(s, '_:')"), "o", "s"))
    closed = single.where("s = o").select(F.col("msg").alias("node")).distinct()  # a loop of its own needs a loop elsewhere; kept
    edges = edges.join(closed, "node", "left_anti")
    everything = one_each.select(*KEYS).unionByName(ground.select(*KEYS))
    targets = side(everything, "s", "o").unionByName(side(everything, "o", "s")).withColumnRenamed("node", "other").distinct()
    often = targets.groupBy("edge").agg(F.count(F.lit(1)).alias("often"))
    rarest = edges.join(often, "edge").groupBy("node").agg(F.min_by("edge", F.struct("often", "edge")).alias("edge"), F.count(F.lit(1)).alias("n"))
    candidates = rarest.join(targets, "edge").where("node <> other").select("node", "n", "other")
    covering = candidates.join(edges, "node").join(targets, ["edge", "other"]).groupBy("node", "other", "n").agg(F.count(F.lit(1)).alias("hits")).where("hits = n")
    size = edges.groupBy("node").agg(F.count(F.lit(1)).alias("m"))
    other_size = size.select(F.col("node").alias("other"), F.col("m").alias("m2"))
    gone = covering.join(other_size, "other", "left").where("m2 is null or m2 > n or node > other").select(F.col("node").alias("msg")).distinct()
    left = one_each.join(gone, "msg", "left_anti").select(*columns)
    if theirs is None:
        return ground.unionByName(left)
    own_ground = mine.where("not startswith(s, '_:') and not startswith(o, '_:')")
    return own_ground.unionByName(left.where(~F.col("s").startswith(THEIRS) & ~F.col("o").startswith(THEIRS)))


def connectivity(statements: list[Quad]) -> tuple[list[str], list[list[bool]]]:
    """Nodes in order, and which are joined by a statement."""
    nodes = sorted({x for s in statements for x in (s[0], s[2])})
    at = {n: i for i, n in enumerate(nodes)}
    matrix = [[False] * len(nodes) for _ in nodes]
    for s, _, o, _ in statements:
        matrix[at[s]][at[o]] = matrix[at[o]][at[s]] = True
    return nodes, matrix


def connected_subgraphs(statements: list[Quad]) -> Iterator[set[str]]:
    """Every connected set of nodes, once, smaller ones first."""
    nodes, matrix = connectivity(statements)
    near = {n: {m for j, m in enumerate(nodes) if matrix[i][j] and m != n} for i, n in enumerate(nodes)}
    level = {frozenset([n]) for n in nodes}
    while level:
        yield from (set(x) for x in sorted(level, key=sorted))
        level = {x | {m} for x in level for n in x for m in near[n] - x}
