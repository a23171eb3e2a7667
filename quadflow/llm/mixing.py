"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadflow.runtime import small

#: Documents per bucket of a source, on average: bounds the rows of one window partition.
BUCKET = 8192
#: How far a source's weight may move from its mean between start and end where no schedule is given.
TILT = 0.5


def running_sizes(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs with before: the tokens of its source's documents that come before it, in an order by hash of doc_id.

    A source is cut into buckets of equal hash ranges, so one with a third of all rows is as many window partitions as
    its rows need; only the totals per source and bucket run through one partition per source.
    """
    n = max(1, docs.count() // bucket)
    h = F.xxhash64("doc_id", F.lit(17))
    cut = docs.withColumn("h", h).withColumn("b", F.pmod(F.col("h"), F.lit(n)))
    totals = cut.groupBy("source", "b").agg(F.sum("n_tokens").alias("t"))
    earlier = totals.select("source", "b", (F.sum("t").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "b").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return cut.withColumn("inside", inside).join(earlier, ["source", "b"]).withColumn("before", F.col("base") + F.col("inside")).drop("h", "b", "inside", "base")


def demands(docs: DataFrame, targets: DataFrame, tilt: float = TILT) -> DataFrame:
    """(profile, source, target_share, max_repeats, supply, share, demand, total, a): what each source has to give.

    total is the largest mixture in which no source is used more than max_repeats times over, so all target shares can
    be met; a source without tokens can give nothing and the others' shares are scaled to 1 (supply and demand are 0).
    a is the slope of the source's weight over the course t in [0, 1]: share * (1 + a * (2t - 1)). Sources that are
    repeated most rise, those with tokens to spare fall; the slopes cancel out in every moment, so weights sum to 1.
    """
    supply = docs.groupBy("source").agg(F.sum("n_tokens").alias("supply"))
    p = Window.partitionBy("profile")
    t = targets.where("profile is not null and source is not null and target_share > 0").join(supply, "source", "left").withColumn("supply", F.coalesce("supply", F.lit(0)))
    t = t.withColumn("repeats", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).withColumn("able", (F.col("supply") > 0) & (F.col("repeats") > 0))
    t = t.withColumn("share", F.when(F.col("able"), F.col("target_share")).otherwise(0.0))
    t = t.withColumn("share", F.try_divide("share", F.sum("share").over(p)))
    t = t.withColumn("total", F.floor(F.min(F.when(F.col("able"), F.col("repeats") * F.col("supply") / F.col("share"))).over(p)))
    t = t.withColumn("demand", F.coalesce(F.col("share") * F.col("total"), F.lit(0.0))).withColumn("use", F.when(F.col("able"), F.col("demand") / F.col("supply")).otherwise(0.0))
    t = t.withColumn("lean", F.col("use") - F.sum(F.col("share") * F.col("use")).over(p))
    t = t.withColumn("a", F.coalesce(F.lit(tilt) * F.try_divide(F.col("lean"), F.max(F.abs("lean")).over(p)), F.lit(0.0)))
    return t.select("profile", "source", "target_share", F.col("repeats").alias("max_repeats"), "supply", "share", "demand", "total", "a")


def tilted(plan: DataFrame) -> DataFrame:
    """(profile, source, t, weight): the schedule that demands() makes up where none is given, linear from start to end."""
    ends = F.array(*[F.struct(F.lit(t).alias("t"), (F.col("share") * (1 + s * F.col("a"))).alias("weight")) for t, s in ((0.0, -1), (1.0, 1))])
    return plan.select("profile", "source", F.explode(ends).alias("x")).select("profile", "source", "x.*")


def curves(schedule: DataFrame) -> DataFrame:
    """(profile, source, curve, area): each source's weight as pieces (t0, t1, w0, w1, c0, c1), linear from one knot to the
    next, with c the integral of the weight up to a piece's start and end; area is that up to 1.

    schedule: (profile, source, t, weight), t from 0 to 1. Before the first and after the last knot the weight stays as
    it is there; several weights of one moment count as their mean, null and negative ones as 0. Its rows are few: a
    source's knots make one array.
    """
    knots = schedule.where("t between 0 and 1").groupBy("profile", "source", F.col("t").cast("double").alias("t")).agg(F.avg(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("w"))
    lists = knots.groupBy("profile", "source").agg(F.array_sort(F.collect_list(F.struct("t", "w"))).alias("k"))
    at = lambda t, w: F.array(F.struct(F.lit(t).alias("t"), w.alias("w")))
    k = F.concat(at(0.0, F.col("k")[0]["w"]), F.col("k"), at(1.0, F.element_at("k", -1)["w"]))
    lists = lists.withColumn("k", k)
    piece = lambda i: F.struct(F.col("k")[i - 1]["t"].alias("t0"), F.col("k")[i]["t"].alias("t1"), F.col("k")[i - 1]["w"].alias("w0"), F.col("k")[i]["w"].alias("w1"))
    lists = lists.withColumn("p", F.filter(F.transform(F.sequence(F.lit(1), F.size("k") - 1), piece), lambda x: x["t1"] > x["t0"]))
    none = F.array().cast("array<struct<t0:double,t1:double,w0:double,w1:double,c0:double,c1:double>>")

    def grown(done: Column, x: Column) -> Column:
        c0 = F.when(F.size(done) > 0, F.try_element_at(done, F.lit(-1))["c1"]).otherwise(0.0)
        c1 = c0 + (x["t1"] - x["t0"]) * (x["w0"] + x["w1"]) / 2
        return F.concat(done, F.array(F.struct(x["t0"].alias("t0"), x["t1"].alias("t1"), x["w0"].alias("w0"), x["w1"].alias("w1"), c0.alias("c0"), c1.alias("c1"))))

    return lists.withColumn("curve", F.aggregate("p", none, grown)).select("profile", "source", "curve", F.element_at("curve", -1)["c1"].alias("area"))


def moment(curve: Column, area: Column, u: Column) -> Column:
    """The t at which a curve's integral reaches the part u of its area; u itself without a curve or an area."""
    goal = u * area
    x = F.try_element_at(F.filter(curve, lambda s: (s["c1"] >= goal) & (s["c1"] > s["c0"])), F.lit(1))
    x = F.coalesce(x, F.element_at(curve, -1))
    rest, slope = F.greatest(goal - x["c0"], F.lit(0.0)), (x["w1"] - x["w0"]) / (x["t1"] - x["t0"])
    root = F.sqrt(F.greatest(x["w0"] * x["w0"] + 2 * slope * rest, F.lit(0.0)))
    inside = x["t0"] + F.when(rest > 0, F.least(2 * rest / (x["w0"] + root), x["t1"] - x["t0"])).otherwise(0.0)
    return F.when(F.coalesce(area, F.lit(0.0)) > 0, inside).otherwise(u)


def mixture(docs: DataFrame, targets: DataFrame, tilt: float = TILT, schedule: DataFrame | None = None) -> DataFrame:
    """(profile, doc_id, source, copy, n_tokens, position), range-sorted by profile and position.

    docs: (doc_id, source, n_tokens); targets: (profile, source, target_share, max_repeats), one row per profile and
    source. A source's documents follow each other by hash, pass after pass; a document is taken in pass copy if its
    middle lies within the source's demand, so a source is off its share by at most half a document. schedule: as of
    curves(), the course of each source's weight; the target share says how much of the source there is, the schedule
    when it comes, so weights count relative to the source's own. A source without a schedule comes evenly; without any
    schedule, demands() makes one up. The integral of the weight is the cumulative demand; position is the moment at
    which that reaches the document's middle. Documents without tokens or source are in no mixture; repeated rows are
    documents of their own; a null max_repeats is 1. No documents or targets: no rows.
    """
    kept = docs.where("source is not null and n_tokens > 0").select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    plan = demands(kept, targets, tilt).where("demand > 0")
    course = curves(tilted(plan) if schedule is None else schedule)
    plan = plan.select("profile", "source", "max_repeats", "supply", "demand").join(course, ["profile", "source"], "left")
    placed = running_sizes(kept).join(small(plan), "source")
    middle = F.col("before") + F.col("n_tokens") / 2
    last = F.least(F.floor((F.col("demand") - middle) / F.col("supply")).cast("bigint"), F.col("max_repeats").cast("bigint") - 1)
    taken = placed.where(last >= 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    t = moment(F.col("curve"), F.col("area"), (F.col("copy") * F.col("supply") + middle) / F.col("demand"))
    return taken.select("profile", "doc_id", "source", "copy", "n_tokens", t.alias("position")).repartitionByRange("profile", "position", "doc_id").sortWithinPartitions("profile", "position", "doc_id")


def reached(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(profile, source, target_share, reached_share, n_tokens, n_pages, max_use, max_repeats, supply) of mixture()."""
    kept = docs.where("source is not null and n_tokens > 0")
    got = mixed.groupBy("profile", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pages"), (F.max("copy") + 1).alias("max_use"))
    rows = demands(kept, targets).select("profile", "source", "target_share", "max_repeats", "supply").join(got, ["profile", "source"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_tokens", "n_pages", "max_use")})
    return rows.withColumn("reached_share", F.coalesce(F.try_divide("n_tokens", F.sum("n_tokens").over(Window.partitionBy("profile"))), F.lit(0.0)))
