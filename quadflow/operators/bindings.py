"""Solutions as DataFrames: one column per variable, held natively as long as that is possible."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadflow.functions import terms as T


@dataclass(frozen=True)
class Form:
    """What a column of a variable holds.

    how "term": canonical text of any term (kind says which, if known). Otherwise the column is native and the term
    follows from it: "iri" (prefix + value), "bnode" (label) or "literal" (value with datatype or language). Two columns
    of the same form are equal exactly if their terms are, so joins and filters work on the native values.
    """

    how: str = "term"
    kind: str | None = None
    prefix: str = ""
    datatype: str | None = None
    lang: str | None = None
    type: str = "string"

    def text(self, c: Column) -> Column:
        """The IRI, label or lexical form."""
        if self.how == "term":
            return T.c_text(c)
        if self.type == "string":
            plain = c
        elif self.type == "timestamp":
            plain = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif self.type in ("double", "float"):
            plain = F.when(F.isnan(c), "NaN").when(c == float("inf"), "INF").when(c == float("-inf"), "-INF").otherwise(c.cast("string"))
        else:
            plain = c.cast("string")
        return F.concat(F.lit(self.prefix), plain) if self.how == "iri" else plain

    def term(self, c: Column) -> Column:
        """The canonical term, null for null."""
        if self.how == "term":
            return c
        if self.how == "iri":
            return T.c_iri(self.text(c))
        if self.how == "bnode":
            return F.concat(F.lit("_:"), c)
        text = self.text(c)
        tail = f"@{self.lang}" if self.lang else f"^^<{self.datatype}>" if self.datatype else ""
        return F.concat(F.lit('"'), T.c_escape(text) if self.type == "string" else text, F.lit('"' + tail))

    def equals(self, c: Column, term: str) -> Column | None:
        """The condition that the column is a constant term; None if it can't be."""
        t = T.parse_term(term)
        if self.kind and self.kind != t.kind:
            return None
        if self.how == "term":
            return c == term
        value = t.value
        if self.how == "iri":
            if not value.startswith(self.prefix):
                return None
            value = value[len(self.prefix) :]
        elif self.how == "literal" and (t.lang != self.lang or t.datatype != self.datatype):
            return None
        if self.type == "string":
            return c == value
        if self.type in ("int", "bigint", "smallint", "tinyint"):
            return c == F.lit(int(value)) if value.lstrip("-").isdigit() and str(int(value)) == value else None
        if self.type == "timestamp":
            return (c == F.lit(value).try_cast("timestamp")) & (self.text(c) == value)
        return self.text(c) == value


TERM = Form()


def column(name: str) -> str:
    """A variable's column; blank nodes of a query become columns no variable can be named like."""
    return "__bnode_" + name[2:] if name.startswith("_:") else name


@dataclass
class Bindings:
    """A bag of solutions. certain: the variables bound in every one."""

    df: DataFrame
    forms: dict[str, Form]
    certain: set[str]

    def col(self, name: str) -> Column:
        return self.df[column(name)]

    def term(self, name: str) -> Column:
        return self.forms[name].term(F.col(f"`{column(name)}`"))

    def terms(self, names: list[str] | None = None) -> DataFrame:
        """The solutions as canonical terms, null where unbound."""
        names = [n for n in self.forms if not n.startswith("_:")] if names is None else names
        return self.df.select(*[(self.term(n) if n in self.forms else F.lit(None).cast("string")).alias(n) for n in names])

    def natives(self, names: list[str] | None = None) -> DataFrame:
        """The solutions as native values: a literal by its datatype where that is known, else text."""
        names = [n for n in self.forms if not n.startswith("_:")] if names is None else names
        out = []
        for n in names:
            if n not in self.forms:
                out.append(F.lit(None).cast("string").alias(n))
            else:
                f, c = self.forms[n], F.col(f"`{column(n)}`")
                out.append((T.c_text(c) if f.how == "term" else c).alias(n))
        return self.df.select(*out)

    def as_terms(self, *names: str) -> Bindings:
        """The same with the named variables held as terms."""
        change = {n: TERM if self.forms[n].kind is None else Form(kind=self.forms[n].kind) for n in names if self.forms[n].how != "term"}
        if not change:
            return self
        df = self.df.withColumns({column(n): self.term(n) for n in change})
        return Bindings(df, self.forms | change, self.certain)

    def where(self, condition: Column) -> Bindings:
        return Bindings(self.df.where(condition), self.forms, self.certain)

    def keep(self, names: list[str]) -> Bindings:
        names = [n for n in names if n in self.forms]
        return Bindings(self.df.select(*[f"`{column(n)}`" for n in names]), {n: self.forms[n] for n in names}, self.certain & set(names))


def unit(spark) -> Bindings:  # noqa: ANN001
    """One solution that binds nothing."""
    return Bindings(spark.range(1).select(), {}, set())


def empty(spark, names: list[str]) -> Bindings:  # noqa: ANN001
    df = spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast("string").alias(column(n)) for n in names])
    return Bindings(df, {n: TERM for n in names}, set(names))


def _alike(a: Bindings, b: Bindings, names: list[str]) -> tuple[Bindings, Bindings]:
    differ = [n for n in names if a.forms[n] != b.forms[n]]
    a, b = a.as_terms(*differ), b.as_terms(*differ)
    for n in differ:  # of the two kinds known, none if they differ
        kind = a.forms[n].kind if a.forms[n].kind == b.forms[n].kind else None
        a.forms, b.forms = a.forms | {n: Form(kind=kind)}, b.forms | {n: Form(kind=kind)}
    return a, b


def union(a: Bindings, b: Bindings) -> Bindings:
    """All solutions of both; a variable one of them lacks is unbound there."""
    a, b = _alike(a, b, [n for n in a.forms if n in b.forms])
    forms = a.forms | b.forms
    if not forms:
        return Bindings(a.df.unionAll(b.df), {}, set())
    return Bindings(a.df.unionByName(b.df, allowMissingColumns=True), forms, a.certain & b.certain)


def union_all(parts: list[Bindings]) -> Bindings:
    return reduce(union, parts)


Condition = Callable[[Bindings], Column]


def join(a: Bindings, b: Bindings, how: str = "inner", condition: Condition | None = None) -> Bindings:
    """The compatible pairs of solutions, for how "left" also those of a without any, for "semi" and "anti" those of a.

    Variables bound on both sides for certain are equi-join keys, in native form where both sides share it. A variable
    that may be unbound on the left splits the left side into its bound and unbound rows; one that may be unbound on the
    right becomes a further condition beside the keys, or splits the right side where there is no key and none may
    be missed.
    """
    shared = [n for n in a.forms if n in b.forms]
    a, b = _alike(a, b, shared)
    loose = [n for n in shared if n not in a.certain]
    if loose:
        n, c = loose[0], F.col(f"`{column(loose[0])}`")
        bound = Bindings(a.df.where(c.isNotNull()), a.forms, a.certain | {n})
        open_forms = {k: f for k, f in a.forms.items() if k != n}
        unbound = Bindings(a.df.where(c.isNull()).drop(column(n)), open_forms, a.certain)
        return union(join(bound, b, how, condition), join(unbound, b, how, condition))
    certain = [n for n in shared if n in b.certain]
    maybe = [n for n in shared if n not in b.certain]
    if maybe and not certain and how == "inner":
        n, c = maybe[0], F.col(f"`{column(maybe[0])}`")
        bound = Bindings(b.df.where(c.isNotNull()), b.forms, b.certain | {n})
        unbound = Bindings(b.df.where(c.isNull()).drop(column(n)), {k: f for k, f in b.forms.items() if k != n}, b.certain)
        return union(join(a, bound, how, condition), join(a, unbound, how, condition))
    if maybe and not certain and how in ("left", "anti", "semi"):
        # the right side's rows that bind the variable are matched by it, the others apart; what neither matches stays
        n, c = maybe[0], F.col(f"`{column(maybe[0])}`")
        bound = Bindings(b.df.where(c.isNotNull()), b.forms, b.certain | {n})
        unbound = Bindings(b.df.where(c.isNull()).drop(column(n)), {k: f for k, f in b.forms.items() if k != n}, b.certain)
        if how == "anti":
            return join(join(a, bound, how, condition), unbound, how, condition)
        if how == "semi":
            return union(join(a, bound, how, condition), join(join(a, bound, "anti", condition), unbound, how, condition))
        met = union(join(a, bound, "inner", condition), join(a, unbound, "inner", condition))
        out = union(met, join(join(a, bound, "anti", condition), unbound, "anti", condition))
        return Bindings(out.df, out.forms, set(a.certain))
    right = b.df.select(*[F.col(f"`{column(n)}`").alias(column(n) + "__r" if n in shared else column(n)) for n in b.forms])
    on = [F.col(f"`{column(n)}`") == F.col(f"`{column(n)}__r`") for n in certain]
    on += [(F.col(f"`{column(n)}`") == F.col(f"`{column(n)}__r`")) | F.col(f"`{column(n)}__r`").isNull() for n in maybe]
    forms = a.forms | {n: f for n, f in b.forms.items() if n not in a.forms}
    if condition is not None:
        on.append(condition(Bindings(a.df, forms, a.certain | (b.certain if how == "inner" else b.certain))))
    test = reduce(lambda x, y: x & y, on) if on else F.lit(True)
    if how in ("semi", "anti"):
        right = right if on else right.limit(1)  # a test of existence
        return Bindings(a.df.join(right, test, f"left_{how}"), a.forms, a.certain)
    df = a.df.crossJoin(right) if how == "inner" and not on else a.df.join(right, test, how)
    return Bindings(df.drop(*[f"{column(n)}__r" for n in shared]), forms, a.certain | b.certain if how == "inner" else set(a.certain))
