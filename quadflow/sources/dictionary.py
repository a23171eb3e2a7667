"""A store whose statements hold ids beside dictionaries of terms: patterns are joined on ids, terms come last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadflow.functions import terms as T
from quadflow.operators.bindings import TERM, Bindings, Form, column
from quadflow.operators.store import KEYS, MEMBER, QuadSource
from quadflow.plans.algebra import Triple, Var
from quadflow.runtime import BROADCAST_ROWS, small, written, written_counted

DEFAULT_META = 1
#: Graphs whose id resolves to nothing are named by it.
GRAPH = "urn:quadflow:graph:"
PARTS = ["term", "o_kind", "o_val", "o_lang", "o_dt"]


def latest(rows: DataFrame, *values: str) -> DataFrame:
    """(id, *values) of each id's row with the latest added_at; without that column, of its greatest values."""
    record = F.struct(*values)
    best = F.max_by(record, "added_at") if "added_at" in rows.columns else F.max(record)
    return rows.where("id is not null").groupBy("id").agg(best.alias("v")).select("id", "v.*")


class DictionarySource:
    """Statements (subject, predicate, objecttype, object, meta) with entities (id, value), bnodes (id) and literals (id,
    value, language, datatype), the latest row of an id counting. objecttype 1 is a literal, meta 1 the default graph.
    Rows whose ids do not resolve are no quads; repeated ones count once.

    Constants are looked up first, so that a pattern is a scan of statements with pushed ids. The patterns of a group
    join on codes (twice the id, plus one for a literal). What is bound is then joined with the dictionary once per
    variable, which drops what does not resolve; variables that nothing else needs are only tested. Codes stand for
    terms only if no two ids have one term, which is tested once; else quads() answers everything, on terms.
    """

    distinct = True

    def __init__(self, statements: DataFrame, entities: DataFrame, bnodes: DataFrame, literals: DataFrame) -> None:
        self.spark = statements.sparkSession
        self.statements = statements.select("subject", "predicate", "objecttype", "object", "meta")
        self.entities, self.bnodes, self.literals = entities, bnodes, literals
        none = F.lit(None).cast("string")
        code = (F.col("id") * 2).alias("id")
        self.named = latest(entities.withColumn("id", code), "value").where("value is not null").select(F.col("id").alias("code"), T.c_iri(F.col("value")).alias("term"), F.lit("U").alias("o_kind"), F.col("value").alias("o_val"), none.alias("o_lang"), none.alias("o_dt"))
        label = F.concat(F.lit("b"), F.col("id").cast("string"))
        blank = bnodes.where("id is not null").select("id").distinct().select((F.col("id") * 2).alias("code"), F.concat(F.lit("_:"), label).alias("term"), F.lit("B").alias("o_kind"), label.alias("o_val"), none.alias("o_lang"), none.alias("o_dt"))
        self.nodes = self.named.unionByName(blank)
        text = latest(literals.withColumn("id", F.col("id") * 2 + 1), "value", "language", "datatype").where("value is not null")
        self.texts = text.select(
            F.col("id").alias("code"), T.c_term(F.lit("L"), F.col("value"), F.col("language"), F.col("datatype")).alias("term"), F.lit("L").alias("o_kind"), F.col("value").alias("o_val"),
            F.col("language").alias("o_lang"), F.when(F.col("language").isNull(), F.col("datatype")).alias("o_dt"),
        )
        self._ids: dict[str, list[int]] = {}
        self._one_to_one: bool | None = None
        self._whole: QuadSource | None = None

    @property
    def one_to_one(self) -> bool:
        """Whether no two ids have, or had, the same term; told by hashes, which can only err to the safe side."""
        if self._one_to_one is None:
            names = self.entities.select(F.xxhash64("value").alias("h"), F.length("value").alias("n"), "id", F.lit(0).alias("kind"))
            texts = self.literals.select(F.xxhash64("value", F.coalesce("language", F.lit("\x00")), F.coalesce(F.when(F.col("language").isNull(), F.col("datatype")), F.lit("\x00"))).alias("h"), F.length("value").alias("n"), "id", F.lit(1).alias("kind"))
            keys = names.unionByName(texts).where("id is not null and n is not null")
            self._one_to_one = keys.groupBy("kind", "h", "n").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").limit(1).isEmpty()
        return self._one_to_one

    def look_up(self, terms: list[str]) -> None:
        """Learns the codes of constants, all of them in one job over the rows with their values."""
        new = [t for t in dict.fromkeys(terms) if t not in self._ids]
        if not new:
            return
        plain = {t: T.parse_term(t) for t in new if t != T.RDFS_MEMBER}
        parts = []
        iris = [p.value for p in plain.values() if p.kind == "U"]
        test = F.col("value").isin(iris) if iris else F.lit(False)
        if T.RDFS_MEMBER in new:
            test |= F.col("value").rlike(MEMBER[2:-2])
        if iris or T.RDFS_MEMBER in new:
            hits = self.entities.where(test).select("id").distinct()
            parts.append(latest(self.entities.join(F.broadcast(hits), "id", "left_semi"), "value").select((F.col("id") * 2).alias("code"), T.c_iri(F.col("value")).alias("term")))
        texts = [p.value for p in plain.values() if p.kind == "L"]
        if texts:
            hits = self.literals.where(F.col("value").isin(texts)).select("id").distinct()
            rows = latest(self.literals.join(small(hits), "id", "left_semi"), "value", "language", "datatype")
            parts.append(rows.select((F.col("id") * 2 + 1).alias("code"), T.c_term(F.lit("L"), F.col("value"), F.col("language"), F.col("datatype")).alias("term")))
        labels = [int(p.value[1:]) for p in plain.values() if p.kind == "B" and p.value[:1] == "b" and p.value[1:].isdigit()]
        if labels:
            parts.append(self.bnodes.where(F.col("id").isin(labels)).select("id").distinct().select((F.col("id") * 2).alias("code"), F.concat(F.lit("_:b"), F.col("id").cast("string")).alias("term")))
        for t in new:
            self._ids[t] = []
        if parts:
            kept = F.col("term").isin(list(plain)) | (F.col("term").rlike(MEMBER) if T.RDFS_MEMBER in new else F.lit(False))
            for code, term in reduce(DataFrame.unionByName, parts).where(kept).collect():  # the ids of the query's own constants
                if term in plain:
                    self._ids[term].append(code)
                if T.RDFS_MEMBER in new and term.startswith(f"<{T.RDF}_"):
                    self._ids[T.RDFS_MEMBER].append(code)

    def _is(self, place: str, terms: list[str]) -> Column:
        """The condition that a column of statements holds one of these terms."""
        codes = [c for t in terms for c in self._ids[t]]
        nodes, texts = sorted(c // 2 for c in codes if c % 2 == 0), sorted(c // 2 for c in codes if c % 2)
        if place == "meta":
            unnamed = [int(t[len(GRAPH) + 1 : -1]) for t in terms if t.startswith(f"<{GRAPH}") and t[len(GRAPH) + 1 : -1].isdigit() and not self._ids[t]]
            test = F.col("meta").isin([*[n for n in nodes if n != DEFAULT_META], *unnamed])
            return test | (F.col("meta") == DEFAULT_META) if "" in terms else test
        test = F.col(place).isin(nodes)
        if place != "object":
            return test
        if not texts:
            return (F.col("objecttype") == 0) & test
        literal = (F.col("objecttype") == 1) & F.col(place).isin(texts)
        return literal if not nodes else (F.col("objecttype") == 0) & test | literal

    # what a source offers
    def may(self, t: Triple) -> bool:  # noqa: ARG002
        return True

    def quads(self) -> DataFrame:
        return self.decode(self.statements)

    def whole(self) -> QuadSource:
        if self._whole is None:
            self._whole = QuadSource(self.quads())
        return self._whole

    def match(self, triples: list[Triple]) -> Bindings | None:
        return self.solve(triples)

    def select(self, wants: dict[str, str | list[str]]) -> DataFrame:
        """Quads whose s, p, o and g are among given terms; only their statements are read and decoded."""
        places = {"s": "subject", "p": "predicate", "o": "object", "g": "meta"}
        lists = {k: [v] if isinstance(v, str) else list(v) for k, v in wants.items()}
        self.look_up([t for k, v in lists.items() for t in v if t or k != "g"])
        self._ids[""] = []
        rows = self.statements
        for k, v in lists.items():
            rows = rows.where(self._is(places[k], v))
        return self.decode(rows)

    def decode(self, statements: DataFrame) -> DataFrame:
        """Quads of statements. Predicates and graphs are few and join first; their terms are broadcast if so counted,
        so a predicate or graph with a third of all statements is in no exchange."""
        some = written(statements.select(F.explode(F.array((F.col("predicate") * 2).alias("p"), (F.col("meta") * 2).alias("g"))).alias("code")).distinct().join(self.nodes.select("code", "term", "o_kind"), "code", "left"), "keys")
        p = small(some.where("o_kind = 'U'").select(F.expr("code div 2").alias("predicate"), F.col("term").alias("p")))
        name = F.when(F.col("code") == 2 * DEFAULT_META, "").otherwise(F.coalesce("term", F.concat(F.lit(f"<{GRAPH}"), F.expr("code div 2").cast("string"), F.lit(">"))))
        g = small(some.where("code is not null").select(F.expr("code div 2").alias("meta"), name.alias("g")))
        once = statements.where("objecttype in (0, 1)").join(p, "predicate").join(g, "meta", "left").select((F.col("subject") * 2).alias("a"), (F.col("object") * 2 + F.col("objecttype")).alias("b"), "p", "g").distinct()
        values = self.nodes.unionByName(self.texts).select(F.col("code").alias("b"), F.col("term").alias("o"), *PARTS[1:])
        rows = once.join(values, "b").join(self.nodes.select(F.col("code").alias("a"), F.col("term").alias("s")), "a").select(*KEYS, *PARTS[1:])
        return rows if self.one_to_one else rows.dropDuplicates(KEYS)

    def solve(self, triples: list[Triple], needed: set[str] | None = None) -> Bindings | None:
        """The solutions of a group of patterns, in an order in which each shares a variable with those before it as far as
        there is one; variables outside needed are tested, not decoded. None if a constant is not in the store."""
        graphs = {t.graph.name for t in triples if isinstance(t.graph, Var)}
        places = {n for t in triples for x in (t.s, t.p, t.o) if isinstance(x, Var) for n in (x.name,)}
        if graphs & places or not self.one_to_one:
            return self._on_terms(triples)
        self.look_up([x for t in triples for x in (t.s, t.p, t.o, t.graph) if isinstance(x, str)])
        subjects = {t.s.name for t in triples if isinstance(t.s, Var)}
        predicates = {t.p.name for t in triples if isinstance(t.p, Var)}
        out: DataFrame | None = None
        for t in triples:
            rows = self._scan(t, subjects | predicates)
            shared = [] if out is None else [c for c in rows.columns if c in out.columns]
            if not t.variables():
                rows = rows.limit(1)
            out = rows if out is None else out.join(rows, shared) if shared else out.crossJoin(rows)
        names = list(dict.fromkeys(n for t in triples for n in t.variables()))
        out = out.drop(*[column(n) for n in names if n in graphs and needed is not None and n not in needed])
        names = [n for n in names if column(n) in out.columns]
        if not names:
            return Bindings(out, {}, set())
        only_nodes = subjects | predicates | graphs
        found, count = written_counted(out, "codes")
        if count <= BROADCAST_ROWS:  # the dictionary's rows of these few codes are all that is read further
            codes = F.broadcast(found.select(F.explode(F.array(*[f"`{column(n)}`" for n in names])).alias("code")).distinct())
            few = F.broadcast(self._terms(codes, set(names) <= only_nodes))
        forms: dict[str, Form] = {}
        for n in names:
            c = column(n)
            if count <= BROADCAST_ROWS:
                terms = few.where("o_kind = 'U'") if n in predicates else few
            else:
                terms = self.named if n in predicates else self.nodes if n in only_nodes else self.nodes.unionByName(self.texts)
            if needed is not None and n not in needed:
                found = found.join(terms.select(F.col("code").alias(c)), c, "left_semi").drop(c)
                continue
            found = found.join(terms.select(F.col("code").alias(c), F.col("term").alias("__term")), c, "left" if n in graphs else "inner")
            term = F.col("__term")
            if n in graphs:
                term = F.coalesce(term, F.concat(F.lit(f"<{GRAPH}"), F.expr(f"`{c}` div 2").cast("string"), F.lit(">")))
            found = found.withColumn(c, term).drop("__term")
            forms[n] = Form(kind="U") if n in predicates else TERM
        return Bindings(found.select(*[f"`{column(n)}`" for n in forms]), forms, set(forms))

    def _terms(self, codes: DataFrame, only_nodes: bool) -> DataFrame:
        """(code, term, o_kind) of a few codes, marked for broadcast."""
        ids = codes.where("code % 2 = 0").select(F.expr("code div 2").alias("id"))
        named = latest(self.entities.join(ids, "id", "left_semi"), "value").where("value is not null").select((F.col("id") * 2).alias("code"), T.c_iri(F.col("value")).alias("term"), F.lit("U").alias("o_kind"))
        blank = self.bnodes.join(ids, "id", "left_semi").select("id").distinct().select((F.col("id") * 2).alias("code"), F.concat(F.lit("_:b"), F.col("id").cast("string")).alias("term"), F.lit("B").alias("o_kind"))
        out = named.unionByName(blank)
        if only_nodes:
            return out
        ids = codes.where("code % 2 = 1").select(F.expr("code div 2").alias("id"))
        text = latest(self.literals.join(ids, "id", "left_semi"), "value", "language", "datatype").where("value is not null")
        return out.unionByName(text.select((F.col("id") * 2 + 1).alias("code"), T.c_term(F.lit("L"), F.col("value"), F.col("language"), F.col("datatype")).alias("term"), F.lit("L").alias("o_kind")))

    def _scan(self, t: Triple, nodes: set[str]) -> DataFrame:
        """The distinct codes of a pattern's variables, from statements with the pattern's constants pushed."""
        rows = self.statements
        rows = rows.where(F.col("meta") == DEFAULT_META) if t.graph is None else rows.where(F.col("meta") != DEFAULT_META) if isinstance(t.graph, Var) else rows.where(self._is("meta", [t.graph]))
        codes: dict[str, Column] = {}
        for place, x in (("subject", t.s), ("predicate", t.p), ("object", t.o), ("meta", t.graph)):
            if x is None:
                continue
            if isinstance(x, str):
                rows = rows if place == "meta" else rows.where(self._is(place, [x]))
                continue
            if place == "object":
                rows = rows.where("objecttype = 0" if x.name in nodes else "objecttype in (0, 1)")
                code = F.col("object") * 2 if x.name in nodes else F.col("object") * 2 + F.col("objecttype")
            else:
                code = F.col(place) * 2
            if x.name in codes:
                rows = rows.where(codes[x.name] == code)
            else:
                codes[x.name] = code
        # a constant subject or object that is in the store resolves; so does a constant predicate
        checks = [c.alias(column(n)) for n, c in codes.items()]
        return rows.select(*checks).distinct() if checks else rows.select(F.lit(1).alias("__one")).limit(1).select()

    def _on_terms(self, triples: list[Triple]) -> Bindings | None:
        from quadflow.operators.bindings import join

        found = [self.whole().match([t]) for t in triples]
        return None if any(f is None for f in found) else reduce(join, found)


def dictionary_source(spark: SparkSession, statements: DataFrame, entities: DataFrame, literals: DataFrame, bnodes: DataFrame | None = None) -> DictionarySource:
    """The source of a store without a table of blank nodes: an id that no entity has, where a node stands, is one."""
    if bnodes is None:
        ids = [statements.select(F.col(c).alias("id")) for c in ("subject", "predicate")] + [statements.where("objecttype = 0").select(F.col("object").alias("id")), statements.where(F.col("meta") != DEFAULT_META).select(F.col("meta").alias("id"))]
        bnodes = reduce(DataFrame.unionByName, ids).distinct().join(entities.select("id").distinct(), "id", "left_anti")
    return DictionarySource(statements, entities, bnodes, literals)
