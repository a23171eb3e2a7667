"""RDFS reasoning: the statements that classes, properties, domains and ranges entail, or patterns widened by them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadflow.functions import terms as T
from quadflow.operators.bindings import Bindings, column, union_all
from quadflow.operators.store import KEYS, QuadSource, QuadStore
from quadflow.plans.algebra import Triple, Var
from quadflow.runtime import BROADCAST_ROWS, written, written_counted

SUB_CLASS, SUB_PROPERTY = f"<{T.RDFS}subClassOf>", f"<{T.RDFS}subPropertyOf>"
DOMAIN, RANGE, RESOURCE = f"<{T.RDFS}domain>", f"<{T.RDFS}range>", f"<{T.RDFS}Resource>"

#: Patterns that are matched one by one; more of them are one scan, joined with their classes or properties.
SCANS = 8
#: Pairs of a closure up to which it is worked out on the driver and may be broadcast, some 20 MB.
PAIRS = 2 * BROADCAST_ROWS


def _walked(edges: list[tuple[str, str]]) -> dict[str, set[str]] | None:
    """All that each term reaches over edges, itself only on a loop; None beyond PAIRS pairs."""
    over = defaultdict(set)
    for a, b in edges:
        over[a].add(b)
    out: dict[str, set[str]] = {}
    left = PAIRS
    for start in over:
        seen, todo = set(), [start]
        while todo:
            for b in over.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
            if len(seen) > left:
                return None
        left -= len(seen)
        out[start] = seen
    return out


def closure(edges: DataFrame) -> DataFrame:
    """(a, b): every b that a reaches over edges (a, b), by one or more of them; cycles are fine.

    Up to BROADCAST_ROWS edges and PAIRS pairs it is worked out on the driver; beyond, by joining the closure with itself
    until it no longer grows, which takes as many rounds as the logarithm of the longest path.
    """
    some = edges.select("a", "b").where("a is not null and b is not null").distinct().limit(BROADCAST_ROWS + 1).collect()
    reach = _walked([(a, b) for a, b in some]) if len(some) <= BROADCAST_ROWS else None
    return _joined_closure(edges) if reach is None else _pairs(edges.sparkSession, reach)


def _pairs(spark: SparkSession, reach: dict[str, set[str]]) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in reach.items() for b in bs], "a string, b string")


def _joined_closure(edges: DataFrame) -> DataFrame:
    now, count = written_counted(edges.select("a", "b").where("a is not null and b is not null").distinct(), "closure")
    while True:
        step = now.join(now.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        more, n = written_counted(now.unionByName(step).distinct(), "closure")
        if n == count:
            return now
        now, count = more, n


class RDFS:
    """schema: quads with subClassOf, subPropertyOf, domain and range statements; others are ignored.

    A schema of at most BROADCAST_ROWS statements whose closures have at most PAIRS pairs is read once and held on the
    driver; a larger one stays in DataFrames, with nothing broadcast or listed that was not counted.
    """

    def __init__(self, schema: DataFrame) -> None:
        self.spark = schema.sparkSession
        used = schema.where(F.col("p").isin(SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE)).select("s", "p", "o")
        rows = used.distinct().limit(BROADCAST_ROWS + 1).collect()
        of = lambda p: [(r["s"], r["o"]) for r in rows if r["p"] == p]
        reach = [_walked(of(p)) for p in (SUB_CLASS, SUB_PROPERTY)] if len(rows) <= BROADCAST_ROWS else [None]
        self.local = None if None in reach else (*reach, of(DOMAIN), of(RANGE))
        if self.local is None:
            pairs = lambda p: written(used.where(F.col("p") == p).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct(), "schema")
            self.classes, self.properties = closure(pairs(SUB_CLASS)), closure(pairs(SUB_PROPERTY))
            self.domains, self.ranges = pairs(DOMAIN), pairs(RANGE)
        else:
            self.classes, self.properties = _pairs(self.spark, reach[0]), _pairs(self.spark, reach[1])
            self.domains, self.ranges = (self.spark.createDataFrame(x, "a string, b string") for x in self.local[2:])

    def _local_properties(self) -> list[tuple]:
        """Rows of _by_property() from a schema on the driver."""
        classes, properties, *ends = self.local
        own = [defaultdict(set), defaultdict(set)]
        for into, pairs in zip(own, ends, strict=True):
            for p, c in pairs:
                into[p] |= {c} | classes.get(c, set())
        out = []
        for p in sorted({*properties, *own[0], *own[1]}):
            made = [sorted(set().union(*[x.get(q, set()) for q in {p} | properties.get(p, set())])) or None for x in own]
            out.append((p, sorted(properties.get(p, ())) or None, *made))
        return out

    def _by_property(self) -> DataFrame:
        """(p, props, doms, rngs): of each property its super-properties, and the classes its subjects and objects have."""
        if self.local is not None:
            rows = self._local_properties()
            if sum(len(x or ()) for r in rows for x in r[1:]) <= PAIRS:
                return F.broadcast(self.spark.createDataFrame(rows, "p string, props array<string>, doms array<string>, rngs array<string>"))
        up = self.properties.select(F.col("a").alias("p"), F.col("b").alias("q"))
        own = self.domains.select("a").union(self.ranges.select("a")).distinct().select(F.col("a").alias("p"), F.col("a").alias("q"))
        reach = up.unionByName(own).distinct()

        def classes(of: DataFrame, name: str) -> DataFrame:
            c = reach.join(of.select(F.col("a").alias("q"), F.col("b").alias("c")), "q").select("p", "c")
            over = c.join(self.classes.select(F.col("a").alias("c"), F.col("b").alias("d")), "c").select("p", F.col("d").alias("c"))
            return c.unionByName(over).groupBy("p").agg(F.collect_set("c").alias(name))

        return up.groupBy("p").agg(F.collect_set("q").alias("props")).join(classes(self.domains, "doms"), "p", "full").join(classes(self.ranges, "rngs"), "p", "full")

    def _supers(self) -> DataFrame:
        """(o, supers): each class with those above it."""
        if self.local is not None:
            return F.broadcast(self.spark.createDataFrame([(c, sorted(x)) for c, x in self.local[0].items()], "o string, supers array<string>"))
        return self.classes.groupBy(F.col("a").alias("o")).agg(F.collect_set("b").alias("supers"))

    def hierarchy(self) -> DataFrame:
        """(s, p, o, g): every subClassOf and subPropertyOf the schema entails, and rdfs:Resource above every class it
        mentions, in the default graph."""
        named = self.classes.select("a").union(self.classes.select("b")).union(self.domains.select("b")).union(self.ranges.select("b")).distinct()
        links = lambda df, p: df.select(F.col("a").alias("s"), F.lit(p).alias("p"), F.col("b").alias("o"), F.lit("").alias("g"))
        top = named.where(F.col("a") != RESOURCE).withColumn("b", F.lit(RESOURCE))
        return links(self.classes.unionByName(top).distinct(), SUB_CLASS).unionByName(links(self.properties, SUB_PROPERTY))

    def apply(self, quads: DataFrame) -> DataFrame:
        """The quads and all that follow from them in their graphs: super-properties, types by domain and range,
        super-classes; and hierarchy(). Each entailed quad comes once.

        What a property and a class entail is worked out on the schema first, so the quads are read once and only the
        last step, which drops repeats, exchanges them.
        """
        rows = quads.select(*KEYS).join(self._by_property(), "p", "left").join(self._supers(), "o", "left")
        kind = F.lit(T.RDF_TYPE)
        part = lambda s, p, o: F.struct(s.alias("s"), p.alias("p"), o.alias("o"))
        none = F.array().cast("array<struct<s:string,p:string,o:string>>")
        each = lambda c, f, test=None: F.coalesce(F.transform(c, f) if test is None else F.when(test, F.transform(c, f)), none)
        s, p, o = F.col("s"), F.col("p"), F.col("o")
        is_type = (p == kind) | F.coalesce(F.array_contains("props", kind), F.lit(False))
        made = F.concat(
            F.array(part(s, p, o)),
            each("props", lambda q: part(s, q, o)),
            each("doms", lambda c: part(s, kind, c)),
            each("rngs", lambda c: part(o, kind, c), ~o.startswith('"')),
            each("supers", lambda c: part(s, kind, c), is_type),
        )
        out = rows.select(F.explode(made).alias("x"), "g").select("x.s", "x.p", "x.o", "g").unionByName(self.hierarchy()).dropDuplicates(KEYS)
        return out.select("*", *T.c_parts(F.col("o")))

    def relevant(self, store: QuadStore, wants: dict[str, str | list[str]]) -> DataFrame | None:
        """The quads from which all that follows that has a predicate, and if that is rdf:type an object, among those
        wanted; None if that may be any, or is not to be listed."""
        lists = {k: [v] if isinstance(v, str) else list(v) for k, v in wants.items()}
        if not lists.get("p") or {T.RDFS_MEMBER, SUB_CLASS, SUB_PROPERTY} & set(lists["p"]):
            return None
        names = [self.below(self.properties, p) for p in lists["p"]]
        if any(n is None for n in names):
            return None
        plain = sorted({x for p, n in zip(lists["p"], names, strict=True) if p != T.RDF_TYPE for x in n})
        parts = [store.select(p=plain)] if plain else []
        if T.RDF_TYPE in lists["p"]:
            kinds = [self.below(self.classes, c) for c in lists["o"]] if lists.get("o") else [None]
            types = names[lists["p"].index(T.RDF_TYPE)]
            parts.append(store.select(p=types) if any(k is None for k in kinds) else store.select(p=types, o=sorted({c for k in kinds for c in k})))
            able = [(r[0],) for r in self._local_properties() if r[2] or r[3]] if self.local is not None else self._by_property().where("doms is not null or rngs is not null").select("p").limit(BROADCAST_ROWS + 1).collect()
            if len(able) > BROADCAST_ROWS:
                return None
            if able:
                parts.append(store.select(p=sorted(r[0] for r in able)))
        return reduce(DataFrame.unionByName, parts)

    def below(self, which: DataFrame, top: str) -> list[str] | None:
        """A term and all that are below it in a closure, found with one small job; None if more than BROADCAST_ROWS are."""
        if self.local is not None:
            reach = self.local[0] if which is self.classes else self.local[1]
            return [top, *sorted(a for a, bs in reach.items() if top in bs and a != top)]
        found = which.where(F.col("b") == top).select("a").limit(BROADCAST_ROWS + 1).collect()
        return None if len(found) > BROADCAST_ROWS else [top, *sorted(r[0] for r in found if r[0] != top)]

    def widen(self, t: Triple) -> list[Triple]:
        """The patterns whose solutions together are those of one under sub-classes and sub-properties; none if they are
        too many to list, for which joined() is there."""
        if t.p == T.RDF_TYPE and isinstance(t.o, str):
            return [replace(t, o=c) for c in self.below(self.classes, t.o) or ()]
        if isinstance(t.p, str) and t.p != T.RDF_TYPE:
            return [replace(t, p=p) for p in self.below(self.properties, t.p) or ()]
        return [t]

    def joined(self, t: Triple, scan: Callable[[list[Triple]], Bindings]) -> Bindings:
        """The solutions of widen(t) by one scan with the class or property left open, joined with the closure."""
        which, at, top = (self.classes, "o", t.o) if t.p == T.RDF_TYPE else (self.properties, "p", t.p)
        out = scan([replace(t, **{at: Var("__below")})])
        terms = which.where(F.col("b") == top).select(F.col("a").alias("__term")).union(self.spark.createDataFrame([(top,)], "__term string"))
        df = out.df.withColumn("__term", out.term("__below")).join(terms, "__term", "left_semi").drop("__term", column("__below"))
        return Bindings(df.distinct(), {n: f for n, f in out.forms.items() if n != "__below"}, out.certain - {"__below"})

    def select_closure(self, p: str, a: str | None = None, b: str | None = None) -> DataFrame:
        """(a, b) of subClassOf or subPropertyOf with one end given."""
        df = self.classes if p == SUB_CLASS else self.properties
        for c, v in (("a", a), ("b", b)):
            df = df if v is None else df.where(F.col(c) == v)
        return df


class WidenedStore(QuadStore):
    """A store whose patterns are rewritten by a schema instead of its statements being added to."""

    def __init__(self, store: QuadStore, schema: RDFS) -> None:
        super().__init__(store.spark, store.sources)
        self.schema = schema

    def home(self, t: Triple):  # noqa: ANN201
        return super().home(t) if t.p not in (SUB_CLASS, SUB_PROPERTY) and len(self.schema.widen(t)) == 1 else None

    def scan(self, triples: list[Triple]) -> Bindings:
        if len(triples) > 1:
            return super().scan(triples)
        if triples[0].p in (SUB_CLASS, SUB_PROPERTY):
            made = self.schema.hierarchy()
            both = QuadStore(self.spark, [*self.sources, QuadSource(made.select("*", *T.c_parts(F.col("o"))))])
            wide = self.schema.widen(triples[0])
            out = union_all([both.scan([w]) for w in wide]) if wide else self.schema.joined(triples[0], both.scan)
            return Bindings(out.df.distinct(), out.forms, out.certain)
        wide = self.schema.widen(triples[0])
        if not wide:
            return self.schema.joined(triples[0], super().scan)
        if len(wide) == 1:
            return super().scan(wide)
        able = [w for w in wide if any(s.may(w) for s in self.sources)]
        if len(able) > SCANS:
            return self.schema.joined(triples[0], super().scan)
        out = union_all([super(WidenedStore, self).scan([w]) for w in able or wide[:1]])
        return Bindings(out.df.distinct(), out.forms, out.certain)
