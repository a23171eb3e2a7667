"""References to records that do not exist: tagged parent and child keys in long form, grouped by parent table and key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def references(statements: DataFrame) -> DataFrame:
    """(stmt_id, side, parent_table, key, at) of every reference; a null key, or an object of unknown kind, is none."""
    sides = F.array(
        F.struct(F.lit("subject").alias("side"), F.lit("resource").alias("parent_table"), F.col("subject").alias("key")),
        F.struct(F.lit("object").alias("side"), F.when(F.col("objecttype") == 0, "resource").when(F.col("objecttype") == 1, "literal").alias("parent_table"), F.col("object").alias("key")),
    )
    return statements.select("stmt_id", F.col("added_at").alias("at"), F.explode(sides).alias("r")).select("stmt_id", "at", "r.side", "r.parent_table", "r.key").where("key is not null and parent_table is not null")


def spans(entities: DataFrame, bnodes: DataFrame, literals: DataFrame) -> DataFrame:
    """(parent_table, key, since, until) of the dictionaries' rows; until null: never removed."""
    rows = [
        (entities, "resource", F.col("removed_at")),
        (bnodes, "resource", F.lit(None).cast("timestamp")),
        (literals, "literal", F.col("removed_at")),
    ]
    return reduce(DataFrame.unionByName, [d.where("id is not null").select(F.lit(t).alias("parent_table"), F.col("id").alias("key"), F.col("added_at").alias("since"), u.alias("until")) for d, t, u in rows])


def _holds(x: Column, at: Column) -> Column:
    return (x["since"] <= at) & (x["until"].isNull() | (at < x["until"]))


def orphan_keys(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(parent_table, key, spans) of referenced keys that lack a parent row for some of their references.

    Both sides become one long form: spans with the parent flag set, and references as the first and last moment per
    key. Both are aggregated before the exchange; rows of a key that were removed at the same moment, or never, become
    the one that began first. A key with a span from before its first reference to after its last one lacks nothing.
    """
    none = F.lit(None).cast("timestamp")
    tagged = parents.groupBy("parent_table", "key", "until").agg(F.min("since").alias("since")).select("parent_table", "key", F.struct("since", "until").alias("span"), F.lit(1).alias("parent"), none.alias("first"), none.alias("last"))
    asked = children.groupBy("parent_table", "key").agg(F.min("at").alias("first"), F.max("at").alias("last")).select("parent_table", "key", F.lit(None).cast("struct<since:timestamp,until:timestamp>").alias("span"), F.lit(0).alias("parent"), "first", "last")
    groups = tagged.unionByName(asked).groupBy("parent_table", "key").agg(F.max("parent").alias("parent"), F.min("parent").alias("child"), F.collect_list("span").alias("spans"), F.max("first").alias("first"), F.max("last").alias("last"))
    covered = F.exists("spans", lambda x: _holds(x, F.col("first")) & _holds(x, F.col("last")))
    return groups.where((F.col("child") == 0) & ((F.col("parent") == 0) | ~F.coalesce(covered, F.lit(False)))).select("parent_table", "key", "spans")


def orphans(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(stmt_id, side, state, parent_table, key, at) of every reference for which no row of its id holds at its moment.

    State is "missing" (no row of the id at all), "deleted" (a row had been added by then) or "late". A parent row
    without added_at never holds; a reference without a moment is "missing" if its id has no row, else no case.
    Repeated statements are a case each. Hot keys: one row per key on the other side of the join, which adaptive
    execution splits.
    """
    keys = orphan_keys(parents, children)
    at = F.col("at")
    state = F.when(F.size("spans") == 0, "missing").when(at.isNull() | F.exists("spans", lambda x: _holds(x, at)), F.lit(None)).when(F.exists("spans", lambda x: x["since"] <= at), "deleted").otherwise("late")
    return children.join(keys, ["parent_table", "key"]).withColumn("state", state).where("state is not null").select("stmt_id", "side", "state", "parent_table", "key", "at")


def orphan_report(cases: DataFrame) -> DataFrame:
    """(parent_table, side, state, period, n_refs, n_keys): cases by month of their moment, period null if they have none."""
    per_key = cases.groupBy("parent_table", "side", "state", F.date_trunc("month", "at").alias("period"), "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("parent_table", "side", "state", "period").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_keys"))
