"""From SPARQL algebra to DataFrames. Catalyst does the rest."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadflow.functions import terms as T
from quadflow.operators.bindings import Bindings, Form, column, empty, join, union, unit
from quadflow.operators.store import QuadSource, QuadStore
from quadflow.plans import algebra as A
from quadflow.plans.expr import condition, conjuncts, sort_keys
from quadflow.plans.sparql import parse
from quadflow.runtime import small, written

#: Quads per predicate that DESCRIBE gives of those that point at a resource.
BACK_LINKS = 100


class Planner:
    """dataset "store": default-graph patterns match the store's default graph and FROM is ignored; "w3c": FROM and FROM
    NAMED make the dataset. max_limit caps the rows of a SELECT."""

    def __init__(self, store: QuadStore, dataset: str = "store", max_limit: int | None = None) -> None:
        self.store, self.dataset, self.max_limit = store, dataset, max_limit
        self.steps: list[str] = []
        self.needed: set[str] | None = None

    # patterns
    def units(self, triples: list[A.Triple]) -> list[list[A.Triple]]:
        """Patterns that one table answers in one scan together, the others alone."""
        stars: dict[tuple, list[A.Triple]] = {}
        for i, t in enumerate(triples):
            home = self.store.home(t)
            stars.setdefault((id(home), t.s, t.graph) if home is not None else (i,), []).append(t)
        return list(stars.values())

    def bgp(self, triples: list[A.Triple]) -> Bindings:
        """Units joined greedily: from the most constants on, those that share the most variables with what is bound."""
        if not triples:
            return unit(self.store.spark)
        names = list(dict.fromkeys(n for t in triples for n in t.variables()))
        if any(isinstance(x, str) and not x.startswith("<") for t in triples for x in (t.p, t.graph) if x is not None) or any(isinstance(t.s, str) and t.s.startswith('"') for t in triples):
            return empty(self.store.spark, names)  # a literal where none can stand
        group = self.store.group_source()
        left = self.units(triples)
        weight = lambda u: sum(isinstance(x, str) for t in u for x in (t.s, t.o)) * 2 + sum(isinstance(t.p, str) for t in u)
        shared = lambda u, seen: len({n for t in u for n in t.variables()} & seen)
        out: Bindings | None = None
        seen: set[str] = set()
        order: list[A.Triple] = []
        while left:
            best = max(left, key=lambda u: (shared(u, seen) > 0, shared(u, seen), weight(u)))
            left.remove(best)
            if group is not None:  # it joins them itself
                self.steps.append(f"{'scan' if not order else 'join' if shared(best, seen) else 'test or product'} {best}")
                order += best
                seen |= {n for t in best for n in t.variables()}
                continue
            found = self.store.scan(best)
            ground = not any(t.variables() for t in best)
            self.steps.append(f"{'scan' if out is None else 'join' if shared(best, seen) else 'test' if ground else 'product'} {best}")
            if ground:  # a test of existence, whatever the number of matches
                found = Bindings(found.df.limit(1), {}, set())
            out = found if out is None else join(out, found)
            seen |= set(found.forms)
        if group is not None:
            out = group.solve(order, self.needed)
            return empty(self.store.spark, [n for n in names if self.needed is None or n in self.needed]) if out is None else out
        return out

    def node(self, n: A.Node) -> Bindings:
        if isinstance(n, A.BGP):
            return self.bgp(n.triples)
        if isinstance(n, A.Join):
            if isinstance(n.left, A.BGP) and isinstance(n.right, A.BGP):
                return self.bgp(n.left.triples + n.right.triples)
            return join(self.node(n.left), self.node(n.right))
        if isinstance(n, A.LeftJoin):
            left, right = self.node(n.left), self.node(n.right)
            test = None if n.condition is None else lambda b: condition(n.condition, b)
            if n.condition is not None:  # what concerns the right side alone is done there
                own = [c for c in conjuncts(n.condition) if c.variables() and c.variables() <= set(right.forms) - set(left.forms)]
                for c in own:
                    right = right.where(condition(c, right))
                rest = [c for c in conjuncts(n.condition) if c not in own]
                test = (lambda b: reduce(lambda x, y: x & y, [condition(c, b) for c in rest])) if rest else None
            return join(left, right, "left", test)
        if isinstance(n, A.Union):
            return union(self.node(n.left), self.node(n.right))
        if isinstance(n, A.Filter):
            tests = conjuncts(n.condition)
            inner = n.node
            if isinstance(inner, A.LeftJoin):  # OPTIONAL with !bound of a variable it always binds: an anti join
                for t in tests:
                    if t.op == "!" and t.args[0].op == "call" and t.args[0].args[0] == "BOUND":
                        name = t.args[0].args[1].args[0]
                        left, right = self.node(inner.left), self.node(inner.right)
                        if name in right.certain and name not in left.forms:
                            test = None if inner.condition is None else lambda b: condition(inner.condition, b)
                            self.steps.append(f"anti join for !bound(?{name})")
                            out = join(left, right, "anti", test)
                            for x in tests:
                                out = out if x is t else out.where(condition(x, out))
                            return out
            out = self.node(inner)
            for t in tests:
                out = out.where(condition(t, out))
            return out
        raise TypeError(type(n).__name__)

    # queries
    def match(self, triples: list[A.Triple], known: dict[str, list[str]], filters: dict[str, list], distinguished: list[str] | None, limit: int | None) -> DataFrame:
        out = self.bgp(triples)
        spark = self.store.spark
        for name, values in known.items():
            rows = values if isinstance(values, DataFrame) else spark.createDataFrame([(v,) for v in values], "x string")
            rows = small(rows.select(F.col(rows.columns[0]).alias(column(name))).distinct())
            out = join(out.as_terms(name) if name in out.forms else out, Bindings(rows, {name: Form()}, {name}))
        for name, tests in filters.items():
            form, c = out.forms[name], F.col(f"`{column(name)}`")
            kind = F.lit(form.kind) if form.kind else T.c_kind(c)
            for f in tests:
                out = out.where(f.condition(kind, form.text(c)))
        df = out.terms(distinguished)
        return df if limit is None else df.limit(limit)

    def solutions(self, q: A.Query) -> Bindings:
        """The solutions of a query's pattern, ordered and cut as it says."""
        self._dataset(q)
        names = A.visible(q.where) if q.variables is None else q.variables
        # in a SELECT, what is neither shown, ordered or tested nor shared between groups of patterns need not become a term
        self.needed = set(names) | {v for e, _ in q.order for v in e.variables()} | A.shared(q.where) if q.form == "SELECT" else None
        out = self.node(q.where)
        if q.order:
            keys = [k for e, asc in q.order for k in sort_keys(e, asc, out)]
            if q.form == "SELECT" and q.distinct:
                shown = [F.col(f"`{column(n)}`") for n in names if n in out.forms]
                if {v for e, _ in q.order for v in e.variables()} <= set(names):
                    out = Bindings(out.keep(names).df.distinct(), {n: out.forms[n] for n in names if n in out.forms}, out.certain & set(names))
                elif not shown:  # all are shown alike
                    out = Bindings(out.df.orderBy(*keys).limit(1), out.forms, out.certain)
                else:  # of solutions that are shown alike, the first in order stands for all
                    first = F.row_number().over(Window.partitionBy(*shown).orderBy(*keys))
                    out = Bindings(out.df.withColumn("__first", first).where("__first = 1").drop("__first"), out.forms, out.certain)
                keys = [k for e, asc in q.order for k in sort_keys(e, asc, out)]
            out = Bindings(out.df.orderBy(*keys), out.forms, out.certain)
        if q.form == "SELECT":
            missing = [n for n in names if n not in out.forms]
            out = out.keep(names)
            if missing:
                df = out.df.withColumns({column(n): F.lit(None).cast("string") for n in missing})
                out = Bindings(df, out.forms | {n: Form() for n in missing}, out.certain).keep(names)
            if q.distinct and not q.order:
                out = Bindings(out.df.distinct(), out.forms, out.certain)
        limit = q.limit if self.max_limit is None or q.form != "SELECT" else min(q.limit, self.max_limit) if q.limit is not None else self.max_limit
        df = out.df.offset(q.offset) if q.offset else out.df
        return Bindings(df if limit is None else df.limit(limit), out.forms, out.certain)

    def _dataset(self, q: A.Query) -> None:
        if self.dataset == "w3c" and (q.default_graphs or q.named_graphs):
            quads = self.store.quads
            default = quads.where(F.col("g").isin(q.default_graphs)).withColumn("g", F.lit("")).dropDuplicates(["s", "p", "o"])
            self.store = QuadStore(self.store.spark, [QuadSource(default.unionByName(quads.where(F.col("g").isin(q.named_graphs))))])

    def run(self, query: str | A.Query) -> DataFrame:
        q = parse(query) if isinstance(query, str) else query
        if q.form == "SELECT":
            out = self.solutions(q)
            return out.terms(A.visible(q.where) if q.variables is None else q.variables)
        if q.form == "ASK":
            return self.store.spark.range(1).select(F.lit(self.ask(q)).alias("result"))
        return self.construct(q) if q.form == "CONSTRUCT" else self.describe(q)

    def natives(self, query: str) -> DataFrame:
        """A SELECT's solutions as native values where their type is known."""
        q = parse(query)
        return self.solutions(q).natives(A.visible(q.where) if q.variables is None else q.variables)

    def ask(self, query: str | A.Query) -> bool:
        q = parse(query) if isinstance(query, str) else query
        return not self.solutions(q).df.limit(1).isEmpty()

    def explain(self, query: str) -> str:
        """The order of joins chosen and Spark's plan."""
        df = self.run(query)
        return "\n".join(self.steps) + "\n" + df._jdf.queryExecution().simpleString()

    def construct(self, q: A.Query) -> DataFrame:
        """The distinct statements of the template for every solution; blank nodes are new in each, statements with
        unbound or misplaced terms are left out."""
        b = self.solutions(q)
        cols = {n: b.term(n) for n in b.forms}
        row = F.sha1(F.concat_ws("\x1f", *[F.coalesce(cols[n], F.lit("\x00")) for n in sorted(cols)])) if cols else F.lit("0")

        def part(x: A.Var | str) -> F.Column:
            if isinstance(x, str):
                return F.lit(x)
            if x.hidden:
                return F.concat(F.lit("_:c"), row, F.lit("_" + x.name[2:]))
            return cols.get(x.name, F.lit(None).cast("string"))

        made = F.array(*[F.struct(part(t.s).alias("s"), part(t.p).alias("p"), part(t.o).alias("o")) for t in q.template]) if q.template else F.array().cast("array<struct<s:string,p:string,o:string>>")
        df = b.df.select(F.explode(made).alias("x")).select("x.*").where(F.col("s").isNotNull() & F.col("o").isNotNull() & F.col("p").startswith("<") & ~F.col("s").startswith('"')).distinct()
        return df.select("s", "p", "o", F.lit("").alias("g"), *T.c_parts(F.col("o")))

    def describe(self, q: A.Query, back_links: int = BACK_LINKS) -> DataFrame:
        """Quads of the resources: their own, those of blank nodes they lead to, per predicate at most back_links that
        point at them (the smallest subjects), and the labels of what their own point at."""
        spark, quads = self.store.spark, self.store.quads
        fixed = [r for r in q.resources if isinstance(r, str)]
        found = spark.createDataFrame([(r,) for r in fixed], "s string")
        if not fixed or any(isinstance(r, A.Var) for r in q.resources):
            b = self.solutions(q)
            names = [r.name for r in q.resources if isinstance(r, A.Var)] or A.visible(q.where)
            for n in names:
                if n in b.forms:
                    found = found.unionByName(b.df.select(b.term(n).alias("s")).where(F.col("s").isNotNull() & ~F.col("s").startswith('"')))
        found = written(found.distinct(), "described")
        at = found
        parts = []
        while True:
            out = written(quads.join(small(at), "s", "left_semi"), "out")
            parts.append(out)
            nodes = out.where("o_kind = 'B'").select(F.col("o").alias("s")).distinct()
            at = written(nodes.join(found, "s", "left_anti"), "bnodes")
            if at.isEmpty():
                break
            found = written(found.unionByName(at), "described")
        own = reduce(DataFrame.unionByName, parts)
        rank = F.row_number().over(Window.partitionBy("o", "p").orderBy("s", "g"))
        back = quads.join(small(found.withColumnRenamed("s", "o")), "o", "left_semi").withColumn("r", rank).where(F.col("r") <= back_links).drop("r")
        label = quads.where(F.col("p") == f"<{T.RDFS}label>").join(own.where("o_kind = 'U'").select(F.col("o").alias("s")).distinct(), "s", "left_semi")
        return reduce(DataFrame.unionByName, [x.select(*quads.columns) for x in (own, back, label)]).dropDuplicates(["s", "p", "o", "g"])


def slice_from(df: DataFrame, start: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows from the start-th on, counted from 1; limit counts the skipped ones too."""
    skip = max((start or 1) - 1, 0)
    df = df.offset(skip) if skip else df
    return df if limit is None else df.limit(max(limit - skip, 0))


class Builder:
    """A graph pattern built up step by step."""

    def __init__(self) -> None:
        self.triples: list[A.Triple] = []
        self.known: dict[str, list[str]] = {}
        self.filters: dict[str, list] = {}
        self.distinguished: list[str] | None = None
        self.start: int | None = None
        self.limit: int | None = None

    def add(self, s: A.Var | str, p: A.Var | str, o: A.Var | str, g: A.Var | str | None = None) -> Builder:
        # blank nodes of a query are variables without a result column
        node = lambda x: A.Var(x) if isinstance(x, str) and x.startswith("_:") else x
        self.triples.append(A.Triple(node(s), p, node(o), g))
        return self

    def variable_range(self, name: str, values: list[str]) -> Builder:
        self.known[name] = values
        return self

    def literal_filter(self, name: str, test: object) -> Builder:
        self.filters.setdefault(name, []).append(test)
        return self

    def distinguish(self, *names: str) -> Builder:
        self.distinguished = [*(self.distinguished or []), *names]
        return self

    def run(self, store: QuadStore) -> DataFrame:
        names = self.distinguished or [n for n in dict.fromkeys(n for t in self.triples for n in t.variables()) if not n.startswith("_:")]
        return slice_from(store.match(self.triples, self.known, self.filters, names), self.start, self.limit)

    @classmethod
    def of_graph(cls, statements: list[tuple]) -> Builder:
        """A query that is itself a graph: blank nodes and variables (?x terms) are its variables; returnLimit and
        returnStart of the query's own vocabulary cut the result; distinctFrom and optional are known but skipped."""
        out = cls()
        for s, p, o, *g in statements:
            if any(x for x in g):
                raise ValueError("a query graph has no named graphs")
            if p.startswith(f"<{QUERY}"):
                word = p[len(QUERY) + 1 : -1]
                if word in ("returnLimit", "returnStart"):
                    setattr(out, "limit" if word == "returnLimit" else "start", int(T.parse_term(o).value))
                continue
            var = lambda x: A.Var(x[1:]) if x.startswith("?") else x
            out.add(var(s), var(p), var(o))
        return out


#: The vocabulary of query graphs.
QUERY = "urn:quadflow:query#"


def rename_graph(triples: list[A.Triple], graph: A.Var | str) -> list[A.Triple]:
    return [replace(t, graph=graph) for t in triples]
