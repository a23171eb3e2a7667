"""Rules evaluated bottom-up: semi-naive rounds of joins until nothing new follows."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quadflow.functions import terms as T
from quadflow.operators.bindings import Bindings, Form, column, join, unit
from quadflow.operators.store import QuadSource, QuadStore
from quadflow.plans.algebra import Triple, Var
from quadflow.reason import mathrel as M
from quadflow.runtime import scratch, written

KNOWN = "s string, p string, o string, rule int, premises array<string>, round int"


@dataclass(frozen=True)
class Call:
    """An arithmetic relation in a body: arguments (one, or the members of a list), and what it gives or is tested with."""

    name: str
    args: tuple[Var | str, ...]
    out: Var | str


@dataclass
class Rule:
    """body => head. Variables of the head that the body lacks stand for new blank nodes."""

    body: list[Triple | Call]
    head: list[Triple]
    name: str = ""

    def __post_init__(self) -> None:
        self.body = [b if isinstance(b, Call) or not isinstance(b.p, str) or M.name_of(b.p) is None else Call(M.name_of(b.p), (b.s,), b.o) for b in self.body]

    def patterns(self) -> list[Triple]:
        return [b for b in self.body if isinstance(b, Triple)]


@dataclass
class RuleEngine:
    """rules, and axioms: statements that hold without premises. A body is read in one graph, the default one.

    A new blank node is labelled by the hash of its rule and the variables' values, so a rule that fires again on the
    same premises adds nothing. Rounds go on until one adds nothing; rules that make new nodes out of new nodes for ever
    can be stopped with an error by max_rounds, which is off unless it is set.
    """

    rules: list[Rule]
    axioms: list[tuple] = field(default_factory=list)
    max_rounds: int | None = None

    def apply(self, quads: DataFrame) -> DataFrame:
        """Quads with what follows from those of the default graph; the reasoner's place in a store."""
        new = self.infer(quads).where("rule >= 0")
        made = new.select("s", "p", "o", F.lit("").alias("g")).select("*", *T.c_parts(F.col("o")))
        return quads.select(*made.columns).unionByName(made)

    def infer(self, quads: DataFrame, all_ways: bool = False) -> DataFrame:
        """(s, p, o, rule, premises): the statements given (rule -1), the axioms (-2 kept as given) and all that follow.

        Every statement comes once, with the first rule found for it and the keys of its premises, "s p o"; all_ways gives
        it once for each rule and premises that it follows from. A round joins what the last one found with all that is
        known, one body pattern at a time, and drops what is known already; a way is found in the round after its last
        premise.
        """
        spark = quads.sparkSession
        base = quads.where("g = ''").select("s", "p", "o").distinct()
        if self.axioms:
            base = base.unionByName(spark.createDataFrame([tuple(a[:3]) for a in self.axioms], "s string, p string, o string")).distinct()
        # a folder a round, so that what is known is one scan and what a round found a part of it
        at, round_ = scratch(spark, "known"), 0
        base.select("s", "p", "o", F.lit(-1).alias("rule"), F.array().cast("array<string>").alias("premises")).write.parquet(f"{at}/round=0")
        ways = []
        for turn in itertools.count():
            if self.max_rounds is not None and turn >= self.max_rounds:
                raise RuntimeError(f"rules still give new statements after {self.max_rounds} rounds")
            known = spark.read.schema(KNOWN).parquet(at)
            stores = {"all": known, "new": known.where(F.col("round") == round_), "old": known.where(F.col("round") < round_)}
            found = []
            for i, r in enumerate(self.rules):
                n = len(r.patterns())
                for first in range(max(n, 1)):
                    if turn and not n:
                        continue
                    found.append(self._fire(i, r, stores, first if turn else None))
                    if not turn:
                        break
            if not found:
                break
            made = reduce(DataFrame.unionByName, found)
            if all_ways:
                made = written(made.distinct(), "ways")
                ways.append(made.select("s", "p", "o", "rule", "premises"))
            new = made.dropDuplicates(["s", "p", "o"]).join(known.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
            round_, seen = round_ + 1, Observation()
            new.select("s", "p", "o", "rule", "premises").observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{at}/round={round_}")
            if not seen.get["n"]:
                break
        known = spark.read.schema(KNOWN).parquet(at)
        if all_ways:
            return reduce(DataFrame.unionByName, [known.where("round = 0").drop("round"), *ways]).distinct()
        return known.drop("round")

    def _fire(self, i: int, r: Rule, known: dict[str, DataFrame], at: int | None) -> DataFrame:
        """What a rule gives if pattern at is the first to match something new; at None: whatever it matches."""
        spark = known["all"].sparkSession
        quads = lambda df: QuadStore(spark, [QuadSource(df.select("s", "p", "o", F.lit("").alias("g")))])
        stores = {k: quads(df) for k, df in known.items()}
        patterns = r.patterns()
        left = [(stores["all" if at is None or k > at else "new" if k == at else "old"].scan([t]), t) for k, t in enumerate(patterns)]
        out: Bindings = unit(spark)
        seen: set[str] = set()
        if at is not None:  # the new statements first: they are few
            out = left.pop(at)[0]
            seen = set(out.forms)
        while left:
            best = max(range(len(left)), key=lambda k: len(set(left[k][0].forms) & seen))
            out = join(out, left.pop(best)[0]) if seen or out.forms else left.pop(best)[0]
            seen = set(out.forms)
        out = self._calls(r, out)
        cols = {n: F.col(f"`{column(n)}`") for n in out.forms}
        row = F.sha1(F.concat_ws("\x1f", F.lit(str(i)), *[cols[n] for n in sorted(cols)]))

        def part(x: Var | str) -> Column:
            if isinstance(x, str):
                return F.lit(x)
            return cols[x.name] if x.name in cols else F.concat(F.lit("_:r"), row, F.lit("_" + "".join(ch for ch in x.name if ch.isalnum())))

        premises = F.array(*[F.concat_ws(" ", part(t.s), part(t.p), part(t.o)) for t in patterns]) if patterns else F.array().cast("array<string>")
        heads = F.array(*[F.struct(part(h.s).alias("s"), part(h.p).alias("p"), part(h.o).alias("o")) for h in r.head])
        df = out.df.select(F.explode(heads).alias("h"), premises.alias("premises"))
        return df.select("h.*", F.lit(i).alias("rule"), "premises").where(~F.col("s").startswith('"') & F.col("p").startswith("<"))

    @staticmethod
    def _calls(r: Rule, out: Bindings) -> Bindings:
        """Arithmetic in an order in which each relation has its inputs."""
        todo = [b for b in r.body if isinstance(b, Call)]
        while todo:
            bound = lambda x: isinstance(x, str) or x.name in out.forms
            col = lambda x: F.lit(x) if isinstance(x, str) else F.col(f"`{column(x.name)}`")
            for c in todo:
                inputs = all(bound(a) for a in c.args)
                if c.name in M.CUSTOM:
                    forward, reverse = M.CUSTOM[c.name]
                    if inputs:
                        value = forward(*[col(a) for a in c.args])
                        out = out.where(value == col(c.out)) if bound(c.out) else _bound(out, c.out.name, value)
                        break
                    if reverse is not None and bound(c.out) and len(c.args) == 1:
                        out = _bound(out, c.args[0].name, reverse(col(c.out)))
                        break
                    continue
                if c.name in M.TEST:
                    pair = (*c.args, c.out) if len(c.args) == 1 else c.args
                    if inputs and (len(c.args) == 2 or bound(c.out)):
                        test = M.test(c.name, *[col(x) for x in pair])
                        if len(c.args) == 2 and bound(c.out):
                            test = test == T.c_boolean(T.c_text(col(c.out)))
                        out = out.where(test)
                        break
                elif inputs:
                    value = M.relation(c.name, [col(a) for a in c.args])
                    out = out.where(M.same(value, col(c.out))) if bound(c.out) else _bound(out, c.out.name, value)
                    break
                elif c.name in M.UNARY and M.UNARY[c.name][1] and bound(c.out):
                    out = _bound(out, c.args[0].name, M.reverse(c.name, col(c.out)))
                    break
            else:
                raise ValueError(f"unsafe rule {r.name or r.head}: {[c.name for c in todo]} lack inputs")
            todo.remove(c)
        return out

    def prove(self, quads: DataFrame, goal: Triple, all_proofs: bool = False) -> DataFrame:
        """(goal, depth, s, p, o, rule, premises): for each statement that matches the goal, the steps of a proof; rule -1
        marks what was given. all_proofs gives every rule and premises by which a step follows, so that each choice of
        one of them per statement is a proof. No rows: no proof."""
        facts = written(self.infer(quads, all_proofs).withColumn("key", F.concat_ws(" ", "s", "p", "o")), "facts")
        hits = facts
        for c, x in (("s", goal.s), ("p", goal.p), ("o", goal.o)):
            if isinstance(x, str):
                hits = hits.where(F.col(c) == x)
        front = hits.select(F.col("key").alias("goal"), "key").distinct()
        seen, depth, parts = None, 0, []
        while True:
            step = written(front.join(facts, "key").withColumn("depth", F.lit(depth)), "proof")
            if step.isEmpty():
                break
            parts.append(step)
            seen = step.select("goal", "key") if seen is None else seen.unionByName(step.select("goal", "key"))
            front = step.select("goal", F.explode("premises").alias("key")).distinct().join(seen, ["goal", "key"], "left_anti")
            depth += 1
        if not parts:
            return facts.limit(0).select(F.col("key").alias("goal"), F.lit(0).alias("depth"), "s", "p", "o", "rule", "premises")
        return reduce(DataFrame.unionByName, parts).select("goal", "depth", "s", "p", "o", "rule", "premises")


def _bound(out: Bindings, name: str, value: Column) -> Bindings:
    """out with a variable bound to a term, without the solutions in which that is null."""
    df = out.df.withColumn(column(name), value)
    return Bindings(df.where(F.col(f"`{column(name)}`").isNotNull()), out.forms | {name: Form()}, out.certain | {name})
