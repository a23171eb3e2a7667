"""Parent-child rows to full hierarchies: level-wise frontier joins from the roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quadflow.runtime import scratch, small, written, written_counted

#: Levels that one job goes down, a power of two.
STRIDE = 8

#: Stands for a null family in keys.
NO_FAMILY = "\x00"
NODE = "family string, node_id bigint, parent_id bigint, n_parents bigint, root_id bigint, depth bigint, path array<bigint>"


def link_edges(statements: DataFrame, predicates: DataFrame) -> DataFrame:
    """(family, child, parent) of the link statements; literal objects and rows with a null end are no links."""
    link = predicates.where("link_family is not null and link_direction in ('up', 'down')").select("predicate", "link_family", "link_direction").distinct()
    up = F.col("link_direction") == "up"
    return (
        statements.where("objecttype = 0 and subject is not null and object is not null")
        .select("subject", "predicate", "object")
        .join(small(link), "predicate")
        .select(F.col("link_family").alias("family"), F.when(up, F.col("subject")).otherwise(F.col("object")).alias("child"), F.when(up, F.col("object")).otherwise(F.col("subject")).alias("parent"))
    )


def strides(links: DataFrame, stride: int, with_path: bool) -> DataFrame:
    """(family, top, child, parent, n_parents, steps, via): each link's child with its ancestors up to stride links above.

    via runs from below top to child. Reach doubles with every join; as a child has one parent, a distance has at most
    as many rows as there are links.
    """
    via = F.array("child") if with_path else F.lit(None).cast("array<bigint>")
    now, reach = links.select("family", F.col("parent").alias("top"), "child", "parent", "n_parents", F.lit(1).cast("bigint").alias("steps"), via.alias("via")), 1
    while reach < stride:
        upper = now.where(F.col("steps") == reach).select("family", F.col("child").alias("mid"), F.col("top").alias("far"), F.col("via").alias("over"))
        lower = now.withColumnRenamed("top", "mid")
        more = lower.join(upper, ["family", "mid"]).select("family", F.col("far").alias("top"), "child", "parent", "n_parents", (F.col("steps") + reach).alias("steps"), F.concat("over", "via").alias("via"))
        now, reach = written(now.unionByName(more), "strides"), 2 * reach
    return now


def hierarchy(edges: DataFrame, with_path: bool = True, stride: int = STRIDE) -> DataFrame:
    """One row per family and node: (family, node_id, parent_id, n_parents, root_id, depth, path).

    edges: (family, child, parent), in any order, repeated or not; further columns are ignored.
    A node without parent is a root: depth 0, itself as root. Of several parents the smallest id counts; n_parents has
    how many there were. A node whose chain of parents never ends has depth -1, the smallest id of the loop as root and
    a null path. A row with a null child or parent is no link; null families form a family of their own. No edges: no rows.

    Each join of a frontier with the links, taken together over the levels of a stride, reaches the next stride levels
    and appends them; the lowest of them are the next frontier. Links not reached when a frontier is empty are those of
    loops and of what hangs below loops. path runs from the root to the node, both included; without with_path it is
    null.
    """
    spark = edges.sparkSession
    links, n_links = written_counted(
        edges.where("child is not null and parent is not null")
        .groupBy(F.coalesce(F.col("family"), F.lit(NO_FAMILY)).alias("family"), "child")
        .agg(F.min("parent").alias("parent"), F.count_distinct("parent").alias("n_parents")),
        "links",
    )
    children = links.select("family", F.col("child").alias("node_id"))
    roots = links.select("family", F.col("parent").alias("node_id")).distinct().join(children, ["family", "node_id"], "left_anti")
    no_id, no_path = F.lit(None).cast("bigint"), F.lit(None).cast("array<bigint>")
    base = scratch(spark, "levels")
    roots.select(
        "family", "node_id", no_id.alias("parent_id"), F.lit(0).cast("bigint").alias("n_parents"), F.col("node_id").alias("root_id"),
        F.lit(0).cast("bigint").alias("depth"), (F.array("node_id") if with_path else no_path).alias("path"),
    ).write.parquet(f"{base}/level=0")
    front, level, reached, more = spark.read.schema(NODE).parquet(f"{base}/level=0"), 0, 0, n_links
    steps = strides(links, stride, with_path) if n_links else links
    while more:
        above = front.select("family", F.col("node_id").alias("top"), "root_id", "depth", "path")
        found = steps.join(above, ["family", "top"]).select(
            "family", F.col("child").alias("node_id"), F.col("parent").alias("parent_id"), "n_parents", "root_id", (F.col("depth") + F.col("steps")).alias("depth"),
            F.concat("path", "via").alias("path"),
        )
        level, seen = level + stride, Observation()
        found.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("depth") == level).alias("last")).write.parquet(f"{base}/level={level}")
        reached, more = reached + seen.get["n"], seen.get["last"]
        front = spark.read.schema(NODE).parquet(f"{base}/level={level}").where(F.col("depth") == level)
    tree = spark.read.schema(NODE + ", level int").parquet(base).drop("level")
    if reached < n_links:
        open_links = links.join(tree.where("depth > 0").select("family", F.col("node_id").alias("child")), ["family", "child"], "left_anti")
        tree = tree.unionByName(loops(open_links))
    return tree.withColumn("family", F.when(F.col("family") != NO_FAMILY, F.col("family")))


def loops(links: DataFrame) -> DataFrame:
    """Rows as of hierarchy() for links of which no chain of parents ends: each node's loop by pointer doubling.

    After round k a node points 2^k parents up and knows the smallest id among the 2^k nodes from itself on. Once the
    set of pointed-at nodes no longer shrinks, it is the set of loop nodes; once the minima no longer change, they
    cover whole loops. Rounds grow with the logarithm of the longest chain.
    """
    now = written(links.select("family", "child", F.col("parent").alias("up"), F.col("child").alias("least"), "parent", "n_parents"), "loop")
    before = None
    while True:
        over = now.select("family", F.col("child").alias("up"), F.col("up").alias("up2"), F.col("least").alias("least2"))
        now = written(now.join(over, ["family", "up"]).select("family", "child", F.col("up2").alias("up"), F.least("least", "least2").alias("least"), "parent", "n_parents"), "loop")
        ends = now.groupBy("family", "up").agg(F.sum(F.col("least").cast("decimal(38,0)")).alias("s"))
        state = tuple(ends.agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s")).first())
        if state == before:
            break
        before = state
    loop = now.select("family", F.col("child").alias("up"), F.col("least").alias("root_id"))
    return now.drop("least").join(loop, ["family", "up"]).select(
        "family", F.col("child").alias("node_id"), F.col("parent").alias("parent_id"), "n_parents", "root_id",
        F.lit(-1).cast("bigint").alias("depth"), F.lit(None).cast("array<bigint>").alias("path"),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """(family, ancestor_id, node_id, distance): each node with each of its ancestors, from hierarchy(..., with_path=True).

    Nodes on or below a loop have no path and hence no pairs here; all_descendants() has theirs too.
    """
    return tree.where("depth > 0").select("family", "node_id", "depth", F.posexplode("path").alias("at", "ancestor_id")).where("at < depth").select("family", "ancestor_id", "node_id", (F.col("depth") - F.col("at")).alias("distance"))


def loop_descendants(tree: DataFrame) -> DataFrame:
    """(family, ancestor_id, node_id, distance) of the nodes on or below loops: each with every other node that its chain
    of parents runs through, at the distance at which the chain first gets there.

    Distances double: after round k each node has its ancestors up to 2^k away and knows the one at 2^k, whose ancestors
    are the next ones. When a round finds no new pair, every chain has come round.
    """
    stray = tree.where("depth = -1").select(F.coalesce("family", F.lit(NO_FAMILY)).alias("family"), "node_id", F.col("parent_id").alias("up"))
    ups = written(stray, "ups")
    pairs, count = written_counted(ups.where("node_id <> up").select("family", F.col("up").alias("ancestor_id"), "node_id", F.lit(1).cast("bigint").alias("distance")), "pairs")
    reach = 1
    while count:
        far = ups.select("family", "node_id", F.col("up").alias("via"))
        own = ups.select("family", F.col("node_id").alias("via"), F.col("node_id").alias("ancestor_id"), F.lit(0).cast("bigint").alias("distance"))
        above = pairs.select("family", F.col("node_id").alias("via"), "ancestor_id", "distance").unionByName(own)
        step = far.join(above, ["family", "via"]).where("ancestor_id <> node_id").select("family", "ancestor_id", "node_id", (F.col("distance") + reach).alias("distance"))
        more, n = written_counted(pairs.unionByName(step).groupBy("family", "ancestor_id", "node_id").agg(F.min("distance").alias("distance")), "pairs")
        if n == count:
            break
        pairs, count, reach = more, n, 2 * reach
        ups = written(far.join(ups.select("family", F.col("node_id").alias("via"), "up"), ["family", "via"]).select("family", "node_id", "up"), "ups")
    return pairs.withColumn("family", F.when(F.col("family") != NO_FAMILY, F.col("family")))


def all_descendants(tree: DataFrame) -> DataFrame:
    """descendants() and loop_descendants(): the pairs of every node, on, below or off loops. No node is its own ancestor."""
    return descendants(tree).unionByName(loop_descendants(tree))
