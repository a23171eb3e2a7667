"""Duplicates hidden by formatting: commutative multiset hashes of normalized fields, verified without sorting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quadflow.runtime import written

#: What normalization leaves out: Unicode classes P and Z, tabs and line breaks.
LEFT_OUT = r"[\p{P}\p{Z}\t\n\x0B\f\r\x{85}]+"
HALF = 0xFFFFFFFF


def normalized(text: Column) -> Column:
    """The text without punctuation and white space, in lower case; the two small sigmas are one letter."""
    return F.translate(F.lower(F.regexp_replace(text, LEFT_OUT, "")), "ς", "σ")


def normal_fields(value: Column, separator: str = ";") -> Column:
    """The non-empty normalized fields of a value; null for null."""
    return F.filter(F.transform(F.split(value, separator), normalized), lambda x: x != "")


def pair_hashes(pairs: Column, turn: int = 0) -> Column:
    """Two 64-bit hashes of each (name, value) pair, others in every turn."""
    salt = [F.lit(turn)] if turn else []
    return F.transform(pairs, lambda x: F.struct(F.xxhash64(*salt, x["name"], x["value"]).alias("first"), F.xxhash64(*salt, F.lit(0x5BD1E995), x["value"], x["name"]).alias("second")))


def fingerprint(hashes: Column, bits: int = 128) -> Column:
    """The sum of all pairs' hashes, whatever their order, in four 32-bit halves.

    Fewer bits are for tests of what happens when fingerprints collide.
    """

    def half(which: str, shift: int) -> Column:
        total = F.aggregate(hashes, F.lit(0).cast("bigint"), lambda s, h: s + F.shiftrightunsigned(h[which], shift).bitwiseAND(F.lit(HALF)))
        return total.bitwiseAND(F.lit(HALF if bits >= 128 else (1 << max(0, bits // 4)) - 1))

    return F.struct(half("first", 0).alias("a"), half("first", 32).alias("b"), half("second", 0).alias("c"), half("second", 32).alias("d"))


def same_fields(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same texts equally often, in any order."""
    times = lambda fields, x: F.size(F.filter(fields, lambda y: y == x))
    as_sets = (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    once = F.size(F.array_distinct(a)) == F.size(a)
    return (F.size(a) == F.size(b)) & as_sets & (once | F.forall(F.array_distinct(a), lambda x: times(a, x) == times(b, x)))


def copy_groups(records: DataFrame, id_column: str = "id", value: str = "value", names: tuple[str, ...] = ("language", "datatype"), bits: int = 128) -> DataFrame:
    """(kept_id, copy_id): each record's id with the smallest id of its group, itself included, ids once.

    Records are copies if all of names and the fields of value are equal after normalization, the fields as a multiset.
    null agrees only with null; a text that normalizes to nothing is not null. Rows with a null id are left out; an id
    with several texts is in the group of each. No rows: no groups.

    Fingerprints and ids alone are grouped first, hashed and combined before the exchange; texts are compared only in
    groups of more than one record, each against the kept one, so a group of a third of all rows is a third of the
    comparisons and adaptive execution splits its join. Records that share a fingerprint but not the fields are hashed
    anew, by other hashes, and grouped again until none is left.
    """
    labels = [f"n{i}" for i in range(len(names))]
    # one projection per step, so that no expression is worked out twice
    rest = records.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("copy_id"), F.col(value).isNull().alias("none"), normal_fields(F.col(value)).alias("fields"), *[normalized(F.col(n)).alias(c) for n, c in zip(names, labels, strict=True)])
    found, turn, left = [], 0, 1
    while left:
        pairs, rest, left = _turn(rest, names, labels, bits if turn == 0 else 128, turn)
        found.append(pairs)
        turn += 1
    return reduce(DataFrame.unionByName, found)


def _turn(bare: DataFrame, names: tuple[str, ...], labels: list[str], bits: int, turn: int) -> tuple[DataFrame, DataFrame, int]:
    """(kept_id, copy_id) of the records that equal the kept one of their fingerprint, and the other records, counted."""
    pairs = F.concat(
        F.when(F.col("none"), F.array(F.struct(F.lit("no value").alias("name"), F.lit("").alias("value")))).otherwise(F.transform("fields", lambda x: F.struct(F.lit("value").alias("name"), x.alias("value")))),
        *[F.array(F.struct(F.lit(n).alias("name"), F.col(c).alias("value"))) for n, c in zip(names, labels, strict=True)],
    )
    hashed = bare.withColumn("hashes", pair_hashes(pairs, turn)).withColumn("f", fingerprint(F.col("hashes"), bits))
    keyed = written(hashed.select("copy_id", "none", "fields", *labels, "f.*"), "copies")
    key = ["a", "b", "c", "d"]
    groups = written(keyed.groupBy(*key).agg(F.min("copy_id").alias("kept_id"), F.max("copy_id").alias("last_id")), "groups")
    members = written(keyed.join(groups.where("kept_id < last_id").drop("last_id"), key), "members")
    record = F.struct("none", "fields", *labels)
    kept = members.where("copy_id = kept_id").groupBy(*key).agg(F.min_by(record, F.xxhash64("none", "fields", *labels)).alias("kept"))
    equal = F.col("none") == F.col("kept.none")
    for c in labels:
        equal &= F.col(c).eqNullSafe(F.col(f"kept.{c}"))
    mine, theirs = F.coalesce("fields", F.array().cast("array<string>")), F.coalesce("kept.fields", F.array().cast("array<string>"))
    seen = Observation()
    met = members.join(kept, key).withColumn("same", equal & same_fields(mine, theirs)).select("kept_id", "copy_id", "same", F.when(~F.col("same"), record).alias("other"))
    judged = written(met.observe(seen, F.count_if(~F.col("same")).alias("n")), "judged")
    alone = groups.where("kept_id = last_id").select("kept_id", F.col("kept_id").alias("copy_id"))
    good = judged.where("same").select("kept_id", "copy_id").distinct().unionByName(alone)
    return good, judged.where("not same").select("copy_id", "other.*"), seen.get["n"]
