"""Quads in DataFrames: sources, template selects, set operations and changes."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadflow.functions import terms as T
from quadflow.operators.bindings import TERM, Bindings, Form, column, empty, union_all
from quadflow.plans.algebra import Triple, Var
from quadflow.runtime import small

log = logging.getLogger("quadflow")
MEMBER = r"^<http://www\.w3\.org/1999/02/22-rdf-syntax-ns#_[0-9]+>$"
KEYS = ["s", "p", "o", "g"]


def quads_of(rows: DataFrame, s: Column, p: Column, o: Column, g: Column | None = None) -> DataFrame:
    """Quads from four columns of canonical terms; g "" or missing is the default graph."""
    base = rows.select(s.alias("s"), p.alias("p"), o.alias("o"), (F.lit("") if g is None else g).alias("g"))
    return base.select("s", "p", "o", "g", *T.c_parts(F.col("o")))


def quads_from(spark: SparkSession, statements: list[tuple]) -> DataFrame:
    """Quads from (s, p, o) or (s, p, o, g) tuples of canonical terms."""
    rows = [(*x, "") if len(x) == 3 else x for x in statements]
    base = spark.createDataFrame(rows, "s string, p string, o string, g string")
    return base.select("*", *T.c_parts(F.col("o")))


def _fit(df: DataFrame, parts: list[tuple[Column, Form, Var | str]]) -> tuple[DataFrame, dict[str, Form]] | None:
    """Rows whose parts agree with a pattern, as columns of its variables; None if none can."""
    seen: dict[str, tuple[Column, Form]] = {}
    conditions: list[Column] = []
    for c, form, want in parts:
        if isinstance(want, Var):
            if want.name in seen:  # the same variable twice: equal terms
                other, f = seen[want.name]
                conditions.append(other == c if f == form else f.term(other) == form.term(c))
            else:
                seen[want.name] = (c, form)
        else:
            test = form.equals(c, want)
            if test is None:
                return None
            conditions.append(test)
    if conditions:
        df = df.where(reduce(lambda x, y: x & y, conditions))
    return df.select(*[c.alias(column(n)) for n, (c, _) in seen.items()]), {n: f for n, (_, f) in seen.items()}


@dataclass
class QuadSource:
    """Statements in a quads DataFrame, which may hold anything. distinct: no quad comes twice."""

    df: DataFrame
    distinct: bool = True

    def quads(self) -> DataFrame:
        return self.df.select(*[x.split()[0] for x in T.QUADS.split(", ")])

    def may(self, t: Triple) -> bool:  # noqa: ARG002
        return True

    def match(self, triples: list[Triple]) -> Bindings | None:
        t = triples[0]
        if isinstance(t.s, str) and t.s.startswith('"') or isinstance(t.p, str) and not t.p.startswith("<"):
            return None
        df = self.df
        parts = [(F.col("s"), TERM, t.s), (F.col("o"), TERM, t.o)]
        if t.p == T.RDFS_MEMBER:
            df = df.where(F.col("p").rlike(MEMBER))
        else:
            parts.insert(1, (F.col("p"), Form(kind="U"), t.p))
        if t.graph is None:
            df = df.where("g = ''")
        else:
            df = df.where("g <> ''") if isinstance(t.graph, Var) else df
            parts.append((F.col("g"), TERM, t.graph))
        fit = _fit(df, parts)
        return None if fit is None else Bindings(*fit, set(fit[1]))


@dataclass
class TableSource:
    """An ordinary table as statements: per row its type and one statement per column that is not null.

    key: the column or expression that names the subject, subject its form; columns: predicate -> (column, form);
    kind: the class of all subjects. graph: None for the default graph, or a column and its form.
    """

    df: DataFrame
    key: Column
    subject: Form
    kind: str
    columns: dict[str, tuple[Column, Form]] = field(default_factory=dict)
    graph: tuple[Column, Form] | None = None
    distinct: bool = True

    def _predicates(self, t: Triple) -> list[str]:
        known = [T.RDF_TYPE, *self.columns]
        return known if isinstance(t.p, Var) else [t.p] if t.p in known else []

    def may(self, t: Triple) -> bool:
        if t.p == T.RDF_TYPE and isinstance(t.o, str) and t.o != self.kind:
            return False
        return (t.graph is None) == (self.graph is None) and bool(self._predicates(t))

    def quads(self) -> DataFrame:
        s = self.subject.term(self.key)
        g = F.lit("") if self.graph is None else self.graph[1].term(self.graph[0])
        kind = F.lit(self.kind)
        none = F.lit(None).cast("string")
        parts = [self.df.select(s.alias("s"), F.lit(T.RDF_TYPE).alias("p"), kind.alias("o"), g.alias("g"), F.lit("U").alias("o_kind"), T.c_text(kind).alias("o_val"), none.alias("o_lang"), none.alias("o_dt"))]
        for p, (c, form) in self.columns.items():
            parts.append(self.df.where(c.isNotNull()).select(s.alias("s"), F.lit(p).alias("p"), form.term(c).alias("o"), g.alias("g"), F.lit(form.kind).alias("o_kind"), form.text(c).alias("o_val"), F.lit(form.lang).cast("string").alias("o_lang"), F.lit(form.datatype).cast("string").alias("o_dt")))
        return reduce(DataFrame.unionByName, parts)

    def by_row(self) -> DataFrame:
        """(s, p, o, g) of quads() from one scan, a row's statements side by side, its subject worked out once."""
        g = F.lit("") if self.graph is None else self.graph[1].term(self.graph[0])
        known = {T.RDF_TYPE: F.lit(self.kind)} | {p: form.term(c) for p, (c, form) in self.columns.items()}
        some = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in known.items()])
        return self.df.select(self.subject.term(self.key).alias("s"), F.explode(some).alias("x"), g.alias("g")).where("x.o is not null").select("s", "x.p", "x.o", "g")

    def match(self, triples: list[Triple]) -> Bindings | None:
        """One scan for all patterns, which share subject and graph; only a single pattern may leave the predicate open."""
        if isinstance(triples[0].p, Var):
            t = triples[0]
            found = []
            for p in self._predicates(t):
                one = self.match([replace(t, p=p)])
                if one is not None:
                    if t.p.name in one.forms:  # the predicate's variable is used elsewhere in the pattern
                        test = one.forms[t.p.name].equals(F.col(f"`{column(t.p.name)}`"), p)
                        one = None if test is None else one.where(test).as_terms(t.p.name)
                    else:
                        one = Bindings(one.df.withColumn(column(t.p.name), F.lit(p)), one.forms | {t.p.name: Form(kind="U")}, one.certain | {t.p.name})
                    if one is not None:
                        found.append(one)
            return union_all(found) if found else None
        parts = [(self.key, self.subject, triples[0].s)]
        df = self.df
        for t in triples:
            if t.p == T.RDF_TYPE and isinstance(t.o, str):
                if t.o != self.kind:
                    return None
            elif t.p == T.RDF_TYPE:
                parts.append((F.lit(self.kind), Form(kind="U"), t.o))
            else:
                c, form = self.columns[t.p]
                df = df.where(c.isNotNull())
                parts.append((c, form, t.o))
        if triples[0].graph is not None:
            parts.append((*self.graph, triples[0].graph))
        fit = _fit(df, parts)
        return None if fit is None else Bindings(*fit, set(fit[1]))


class ReasonedSource:
    """A store's statements and those that a reasoner adds, worked out when first asked for. A reasoner with a method
    relevant(store, wants) says which statements a template needs, so that a select reasons over those alone."""

    distinct = True

    def __init__(self, store: QuadStore, reasoner) -> None:  # noqa: ANN001
        self.store, self.reasoner = store, reasoner
        self._all: QuadSource | None = None

    def _source(self) -> QuadSource:
        if self._all is None:
            self._all = QuadSource(self.reasoner.apply(self.store.quads))
        return self._all

    def quads(self) -> DataFrame:
        return self._source().quads()

    def may(self, t: Triple) -> bool:  # noqa: ARG002
        return True

    def match(self, triples: list[Triple]) -> Bindings | None:
        return self._source().match(triples)

    def select(self, wants: dict[str, str | list[str]]) -> DataFrame:
        some = self.reasoner.relevant(self.store, wants) if hasattr(self.reasoner, "relevant") else None
        return self.quads() if some is None else self.reasoner.apply(some)


class QuadStore:
    """A set of sources. Selects give quads; match() and the SPARQL planner give solutions. Changes give a new store."""

    def __init__(self, spark: SparkSession, sources: list | None = None, reasoners: list | None = None) -> None:
        self.spark, self.sources, self.reasoners = spark, list(sources or []), list(reasoners or [])
        self._quads: DataFrame | None = None

    @classmethod
    def of(cls, quads: DataFrame, distinct: bool = False) -> QuadStore:
        """A store of quads; unless they are known to be distinct, repeated ones count once."""
        return cls(quads.sparkSession, [QuadSource(quads if distinct else quads.dropDuplicates(KEYS))])

    @classmethod
    def from_statements(cls, spark: SparkSession, statements: list[tuple]) -> QuadStore:
        return cls.of(quads_from(spark, list(dict.fromkeys(statements))), distinct=True)

    # sources
    def add_source(self, source: DataFrame | QuadSource | TableSource, graph: str | None = None) -> QuadStore:
        """With one more source; a graph names all of its statements."""
        if isinstance(source, DataFrame):
            source = QuadSource(source.withColumn("g", F.lit(graph)) if graph else source)
        elif graph and isinstance(source, TableSource):
            source = replace(source, graph=(F.lit(graph), TERM))
        elif graph:
            source = QuadSource(source.quads().withColumn("g", F.lit(graph)), source.distinct)
        return QuadStore(self.spark, [*self.sources, source], self.reasoners)

    def with_reasoner(self, reasoner) -> QuadStore:  # noqa: ANN001
        """With the statements a reasoner adds; the one added last works on what the earlier ones give."""
        return QuadStore(self.spark, [ReasonedSource(self, reasoner)], [*self.reasoners, reasoner])

    @property
    def distinct(self) -> bool:
        """Whether no quad comes twice."""
        return len(self.sources) <= 1 and all(s.distinct for s in self.sources)

    @property
    def quads(self) -> DataFrame:
        if self._quads is None:
            parts = [s.quads() for s in self.sources]
            self._quads = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], T.QUADS)
        return self._quads

    def by_row(self) -> DataFrame:
        """(s, p, o, g) of all quads, those of a table's row side by side: for whoever wants them whole."""
        parts = [s.by_row() if isinstance(s, TableSource) else s.quads().select(*KEYS) for s in self.sources]
        return reduce(DataFrame.unionByName, parts) if parts else self.quads.select(*KEYS)

    def cached(self) -> QuadStore:
        return QuadStore(self.spark, [QuadSource(self.quads.persist(), self.distinct)], self.reasoners)

    def explained(self) -> QuadStore:
        """The same store, whose matches log the plans they make."""
        out = QuadStore(self.spark, self.sources, self.reasoners)
        inner = out.scan

        def scan(triples: list[Triple]) -> Bindings:
            found = inner(triples)
            log.info("scan %s\n%s", triples, found.df._jdf.queryExecution().simpleString())
            return found

        out.scan = scan
        return out

    # patterns
    def home(self, t: Triple):  # noqa: ANN201
        """The only source that may answer a pattern of known predicate, or None."""
        able = [s for s in self.sources if s.may(t)]
        return able[0] if len(able) == 1 and isinstance(able[0], TableSource) and isinstance(t.p, str) else None

    def group_source(self):  # noqa: ANN201
        """The source that answers whole groups of patterns by itself, if it is the only one, or None."""
        plain = type(self).scan is QuadStore.scan and "scan" not in self.__dict__
        return self.sources[0] if plain and len(self.sources) == 1 and hasattr(self.sources[0], "solve") else None

    def scan(self, triples: list[Triple]) -> Bindings:
        """The solutions of one pattern, or of several that one table answers in one scan."""
        names = list(dict.fromkeys(n for t in triples for n in t.variables()))
        found = [b for s in self.sources if s.may(triples[0]) and (b := s.match(triples)) is not None]
        if not found:
            return empty(self.spark, names)
        return union_all(found)

    def meta_query(self, triples: list[Triple]) -> list[bool]:
        """For each pattern whether any source may hold data for it."""
        return [any(s.may(t) and s.match([t]) is not None for s in self.sources) for t in triples]

    # selects
    def select(self, s=None, p=None, o=None, g=None, filters=(), limit: int | None = None) -> DataFrame:  # noqa: ANN001
        """Quads that match a template. None matches all; a list any of its terms; a DataFrame of one column any of its
        values. filters apply to the object and let only literals pass. rdfs:member matches every rdf:_n."""
        wants = {k: x if isinstance(x, str) else list(x) for k, x in zip(KEYS, (s, p, o, g), strict=True) if x is not None and not isinstance(x, DataFrame)}
        parts = [x.select(wants) if wants and hasattr(x, "select") else x.quads() for x in self.sources]
        df = reduce(DataFrame.unionByName, parts) if parts else self.quads
        for name, want in zip(KEYS, (s, p, o, g), strict=True):
            if want is None:
                continue
            if name == "p" and want == T.RDFS_MEMBER:
                df = df.where(F.col("p").rlike(MEMBER))
            elif isinstance(want, DataFrame):
                df = df.join(small(want.select(F.col(want.columns[0]).alias(name)).distinct()), name, "left_semi")
            elif isinstance(want, str):
                df = df.where(F.col(name) == want)
            elif name == "p" and T.RDFS_MEMBER in want:
                df = df.where(F.col("p").isin([x for x in want if x != T.RDFS_MEMBER]) | F.col("p").rlike(MEMBER))
            else:
                df = df.where(F.col(name).isin(list(want)))
        for f in filters:
            df = df.where(f.condition(F.col("o_kind"), F.col("o_val")))
        df = df.select("s", "p", "o", "g", "o_kind", "o_val", "o_lang", "o_dt")
        return df if limit is None else df.limit(limit)

    def contains(self, s=None, p=None, o=None, g=None) -> bool:  # noqa: ANN001
        return not self.select(s, p, o, g).limit(1).isEmpty()

    def contains_term(self, term: str) -> bool:
        return not self.quads.where((F.col("s") == term) | (F.col("p") == term) | (F.col("o") == term) | (F.col("g") == term)).limit(1).isEmpty()

    def select_objects(self, s: str, p: str) -> DataFrame:
        """(o): the distinct objects; members of a container in the order of their numbers."""
        if p == T.RDFS_MEMBER:
            n = F.regexp_extract("p", "_([0-9]+)>$", 1).try_cast("bigint")
            return self.select(s, p).groupBy("o").agg(F.min(n).alias("n")).orderBy(F.col("n").asc_nulls_last(), "o").select("o")
        return self.select(s, p).select("o").distinct()

    def select_subjects(self, p: str, o: str) -> DataFrame:
        return self.select(p=p, o=o).select("s").distinct()

    def entities_of_type(self, kind: str) -> DataFrame:
        return self.select_subjects(T.RDF_TYPE, kind)

    def entities(self) -> DataFrame:
        """(term): every IRI and blank node in any position, the default graph excepted."""
        places = F.array("s", "p", F.when(F.col("o_kind") != "L", F.col("o")), F.when(F.col("g") != "", F.col("g")))
        return self.quads.select(F.explode(places).alias("term")).where("term is not null").distinct()

    def predicates(self) -> DataFrame:
        return self.quads.select(F.col("p").alias("term")).distinct()

    def graphs(self, with_default: bool = False) -> DataFrame:
        df = self.quads.select(F.col("g").alias("term")).distinct()
        return df if with_default else df.where("term <> ''")

    def count(self) -> int:
        return self.quads.count()

    def lists(self, head_of: DataFrame | None = None) -> DataFrame:
        """(head, items): every collection as an array, heads being cells no other cell's rest. A chain of cells that never
        ends, as it runs into a loop, is no collection; one that breaks off ends there. Of several items or rests of a
        cell the smallest counts. head_of: (cell) limits the heads.

        Pointer doubling: the jump of 2^k cells comes from joining that of half as many with itself, and so do the cells
        of each head, in rounds that grow with the logarithm of the longest collection.
        """
        from quadflow.runtime import written, written_counted

        rests = self.select(p=T.RDF_REST).groupBy(F.col("s").alias("cell")).agg(F.min("o").alias("next"))
        first = self.select(p=T.RDF_FIRST).groupBy(F.col("s").alias("cell")).agg(F.min("o").alias("item"))
        rests = written(rests, "rests")
        cells, n = written_counted(rests.join(first, "cell"), "cells")
        jump, far, jumps = cells.select("cell", F.col("next").alias("to")).join(cells.select(F.col("cell").alias("to")), "to", "left_semi"), 1, []
        while True:
            jump, left = written_counted(jump.select("cell", "to"), "jump")
            if not left:
                break
            jumps.append(jump)
            if far > n:  # no chain of n cells has so many: these have come round
                break
            jump, far = jump.join(jump.select(F.col("cell").alias("to"), F.col("to").alias("past")), "to").select("cell", F.col("past").alias("to")), 2 * far
        heads = cells.select("cell").join(rests.select(F.col("next").alias("cell")), "cell", "left_anti")
        heads = heads if head_of is None else heads.join(head_of, "cell", "left_semi")
        if left:
            heads = heads.join(jump.select("cell"), "cell", "left_anti")
        reach, far = heads.select(F.col("cell").alias("head"), "cell", F.lit(0).cast("bigint").alias("n")), 1
        for jump in jumps:
            reach = written(reach.unionByName(reach.join(jump, "cell").select("head", F.col("to").alias("cell"), (F.col("n") + far).alias("n"))), "list")
            far *= 2
        return reach.join(cells.select("cell", "item"), "cell").groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]).alias("items"))

    # changes
    def _new(self, quads: DataFrame, distinct: bool = True) -> QuadStore:
        return QuadStore(self.spark, [QuadSource(quads, distinct)])

    def add(self, *statements: tuple) -> QuadStore:
        return self.import_quads(quads_from(self.spark, list(statements)))

    def import_quads(self, quads: DataFrame) -> QuadStore:
        """With further quads; what is there already is not added again."""
        return self._new(self.quads.unionByName(quads.select(*self.quads.columns)).dropDuplicates(KEYS))

    def _matches(self, s, p, o, g) -> Column:  # noqa: ANN001
        tests = [F.col(k) == v for k, v in zip(KEYS, (s, p, o, g), strict=True) if v is not None]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def remove(self, s=None, p=None, o=None, g=None) -> QuadStore:  # noqa: ANN001
        """Without the quads that match a template."""
        return self._new(self.quads.where(~self._matches(s, p, o, g)))

    def remove_all(self, templates: list[tuple]) -> QuadStore:
        out = self
        for t in templates:
            out = out.remove(*t)
        return out

    def clear(self) -> QuadStore:
        return QuadStore(self.spark, [])

    def replace_entity(self, old: str, new: str) -> QuadStore:
        """With one entity in place of another, wherever it stands."""
        df = self.quads.select(*[F.when(F.col(k) == old, new).otherwise(F.col(k)).alias(k) for k in KEYS])
        return self._new(df.select("*", *T.c_parts(F.col("o"))).dropDuplicates(KEYS))

    def replace_statement(self, old: tuple, new: tuple) -> QuadStore:
        """With one statement in place of another, if that is there."""
        old, new = ((*x, "") if len(x) == 3 else x for x in (old, new))
        hit = self._matches(*old)
        df = self.quads.select(*[F.when(hit, v).otherwise(F.col(k)).alias(k) for k, v in zip(KEYS, new, strict=True)])
        return self._new(df.select("*", *T.c_parts(F.col("o"))).dropDuplicates(KEYS))

    def minus(self, other: QuadStore) -> QuadStore:
        """Quads that the other store lacks."""
        return self._new(self.quads.join(other.quads.select(*KEYS), KEYS, "left_anti").select(*self.quads.columns), self.distinct)

    def skolemize(self, base: str = "urn:quadflow:bnode:") -> QuadStore:
        """Blank nodes as IRIs that unskolemize() turns back."""
        return self._renamed(lambda c: F.when(c.startswith("_:"), F.concat(F.lit("<" + base), c.substr(F.lit(3), F.length(c)), F.lit(">"))).otherwise(c))

    def unskolemize(self, base: str = "urn:quadflow:bnode:") -> QuadStore:
        n = len(base) + 2
        return self._renamed(lambda c: F.when(c.startswith("<" + base), F.concat(F.lit("_:"), c.substr(F.lit(n), F.length(c) - n))).otherwise(c))

    def _renamed(self, change) -> QuadStore:  # noqa: ANN001
        df = self.quads.select(*[change(F.col(k)).alias(k) for k in KEYS])
        return self._new(df.select("*", *T.c_parts(F.col("o"))), self.distinct)

    def write(self, path: str, overwrite: bool = False) -> None:
        """The quads as Parquet, in ranges of predicate, subject and object, so that a pattern reads only its files and a
        predicate of a third of all quads is many of them. overwrite replaces what is there, except what the store
        itself is read from, which is an error."""
        df = self.quads
        if overwrite:
            plain = lambda x: "/" + x.split(":", 1)[-1].lstrip("/")
            if any(plain(f).startswith(plain(path).rstrip("/") + "/") for f in df.inputFiles()):
                raise ValueError(f"the store is read from {path}")
        df.repartitionByRange("p", "s", "o").sortWithinPartitions("p", "s", "o").write.mode("overwrite" if overwrite else "error").parquet(path)

    # queries
    def match(self, triples: list[Triple], known: dict[str, list[str]] | None = None, filters: dict[str, list] | None = None, distinguished: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """Solutions of a graph pattern as terms: known restricts variables to given terms, filters to literals that
        pass, distinguished names the result's columns."""
        from quadflow.plans.planner import Planner

        return Planner(self).match(triples, known or {}, filters or {}, distinguished, limit)

    def query(self, text: str, **options: object) -> DataFrame:
        """Runs SPARQL; SELECT gives terms, ASK one row (result), CONSTRUCT and DESCRIBE quads."""
        from quadflow.plans.planner import Planner

        return Planner(self, **options).run(text)
