"""SPARQL expressions as Spark columns; null stands for an error."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quadflow.functions import terms as T
from quadflow.operators.bindings import Bindings, column
from quadflow.plans.algebra import Expr

TYPES = ("num", "str", "bool", "time")
_META = re.compile(r"[\\.\[\]{}()*+?|^$]")


@dataclass
class Val:
    """A value by type: each present entry gives it as that type, null where it is of another one.

    text is the lexical form or IRI, term the canonical term, kind its kind. exact gives an integer or decimal, null for
    others and beyond 38 digits, where num is but a double.
    """

    term: Callable[[], Column]
    kind: Callable[[], Column]
    text: Callable[[], Column]
    typed: dict[str, Callable[[], Column]] = field(default_factory=dict)
    only: bool = False  # never of another type than those in typed
    lang: Callable[[], Column] | None = None
    datatype: Callable[[], Column] | None = None
    exact: Callable[[], list[Column]] | None = None


def _exact(text: Column, datatype: Column | None = None) -> list[Column]:
    """A number as decimal(38,18) and, if it is whole, as decimal(38,0); null where it does not fit."""
    plain = text.rlike(r"^\s*[+-]?([0-9]{1,20}(\.[0-9]{0,18})?|\.[0-9]{1,18})\s*$")
    whole = text.rlike(r"^\s*[+-]?[0-9]{1,38}\s*$")
    if datatype is not None:
        able = datatype.isin(*[T.XSD + n for n in (*T.INTEGERS, "decimal")])
        plain, whole = able & plain, able & whole
    bare = F.trim(F.regexp_replace(text, r"\s", ""))
    return [F.when(plain, bare.try_cast("decimal(38,18)")), F.when(whole, bare.try_cast("decimal(38,0)"))]


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _of_typed(name: str, c: Column, datatype: str) -> Val:
    """The value of a column of one type."""
    text = (lambda: F.when(c, "true").otherwise("false")) if name == "bool" else (lambda: c.cast("string"))
    tail = F.lit(f'"^^<{datatype}>') if datatype else F.lit('"')
    return Val(
        term=lambda: F.when(c.isNotNull(), F.concat(F.lit('"'), T.c_escape(text()) if name == "str" else text(), tail)),
        kind=lambda: F.when(c.isNotNull(), "L"), text=text, typed={name: lambda: c}, only=True,
        lang=lambda: F.when(c.isNotNull(), ""), datatype=lambda: F.when(c.isNotNull(), datatype or T.XSD + "string"),
    )


def _of_term(c: Column) -> Val:
    """The value of a column of canonical terms."""
    text, dt, lang = T.c_text(c), T.c_datatype(c), T.c_lang(c)
    numeric = [T.XSD + n for n in T.NUMERIC]
    return Val(
        term=lambda: c, kind=lambda: T.c_kind(c), text=lambda: text,
        typed={
            "num": lambda: F.when(dt.isin(*numeric), T.c_double(text)),
            "str": lambda: F.when(c.startswith('"') & (lang == "") & (dt.isNull() | (dt == T.XSD + "string")), text),
            "bool": lambda: F.when(dt == T.XSD + "boolean", T.c_boolean(text)),
            "time": lambda: F.when(dt.isin(T.XSD + "dateTime", T.XSD + "date"), text.try_cast("timestamp")),
        },
        lang=lambda: lang, datatype=lambda: F.when(c.startswith('"') & (lang == ""), F.coalesce(dt, F.lit(T.XSD + "string"))),
        exact=lambda: _exact(text, dt),
    )


def _of_constant(term: str) -> Val:
    t = T.parse_term(term)
    name = (t.datatype or "")[len(T.XSD) :] if (t.datatype or "").startswith(T.XSD) else ""
    if t.kind == "L" and not t.lang:
        value = T.to_value(term)
        if name in T.NUMERIC and value is not None:
            v = _of_typed("num", F.lit(t.value).cast("double") if name in ("float", "double") else F.lit(int(value)) if isinstance(value, int) and abs(value) < 2**63 else F.lit(t.value).cast("decimal(38,18)"), t.datatype)
            v.text, v.term = (lambda: F.lit(t.value)), (lambda: F.lit(term))
            v.exact = None if name in ("float", "double") else lambda: _exact(F.lit(t.value))
            return v
        if name in ("", "string") and t.datatype in (None, T.XSD + "string"):
            return _of_typed("str", F.lit(t.value), t.datatype or "")
        if name == "boolean" and value is not None:
            return _of_typed("bool", F.lit(value), t.datatype)
        if name in ("dateTime", "date") and value is not None:
            v = _of_typed("time", F.lit(t.value).try_cast("timestamp"), t.datatype)
            v.text, v.term = (lambda: F.lit(t.value)), (lambda: F.lit(term))
            return v
    return Val(
        term=lambda: F.lit(term), kind=lambda: F.lit(t.kind), text=lambda: F.lit(t.value), typed={}, only=True,
        lang=lambda: F.lit(t.lang or "") if t.kind == "L" else _null(), datatype=lambda: _null() if t.kind != "L" or t.lang else F.lit(t.datatype or T.XSD + "string"),
    )


def _of_variable(name: str, b: Bindings) -> Val:
    form, c = b.forms[name], F.col(f"`{column(name)}`")
    if form.how == "term":
        if form.kind in ("U", "B"):
            return Val(term=lambda: c, kind=lambda: F.when(c.isNotNull(), form.kind), text=lambda: T.c_text(c), only=True, lang=_null, datatype=_null)
        return _of_term(c)
    there = lambda x: F.when(c.isNotNull(), F.lit(x))
    short = (form.datatype or "").removeprefix(T.XSD)
    typed: dict[str, Callable[[], Column]] = {}
    if form.how == "literal" and not form.lang:
        if form.type == "string" and form.datatype in (None, T.XSD + "string"):
            typed["str"] = lambda: c
        elif form.type in ("int", "bigint", "smallint", "tinyint", "double", "float") or form.type.startswith("decimal"):
            typed["num"] = lambda: c
        elif form.type == "boolean":
            typed["bool"] = lambda: c
        elif form.type in ("timestamp", "date"):
            typed["time"] = lambda: c
        elif short in T.NUMERIC:
            typed["num"] = lambda: T.c_double(c)
    natural = form.how == "literal" and (form.type in ("int", "bigint", "smallint", "tinyint") or form.type.startswith("decimal"))
    return Val(
        exact=(lambda: [c.try_cast("decimal(38,18)"), c.cast("decimal(38,0)") if not form.type.startswith("decimal") else _null("decimal(38,0)")]) if natural else None,
        term=lambda: form.term(c), kind=lambda: there(form.kind), text=lambda: form.text(c), typed=typed, only=True,
        lang=lambda: there(form.lang or "") if form.how == "literal" else _null(), datatype=lambda: there(form.datatype or T.XSD + "string") if form.how == "literal" and not form.lang else _null(),
    )


_OPS = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def _first(columns: list[Column], kind: str = "boolean") -> Column:
    return F.coalesce(*columns) if len(columns) > 1 else columns[0] if columns else _null(kind)


def compare(op: str, a: Val, b: Val) -> Column:
    """= and != by value where both are of one type, else by term; the others by value only."""
    shared = [t for t in TYPES if t in a.typed and t in b.typed]
    tests = [_OPS[op](a.typed[t](), b.typed[t]()) for t in shared]
    if "num" in shared and a.exact and b.exact and not (a.only and b.only):  # exactly where both can, else as doubles
        tests = [_OPS[op](x, y) for x, y in zip(a.exact(), b.exact(), strict=True)] + tests
    if op in ("=", "!=") and not (len(shared) == 1 and a.only and b.only and len(a.typed) == len(b.typed) == 1):
        same = a.term() == b.term()
        literals = (a.kind() == "L") & (b.kind() == "L")
        # two literals of no common type are equal if they are one term, else there is no telling
        unlike = F.when(same, op == "=").when(~literals, op != "=")
        tests.append(F.when(a.term().isNotNull() & b.term().isNotNull(), unlike))
    return _first(tests)


def truth(v: Val) -> Column:
    """The effective boolean value."""
    tests = []
    if "bool" in v.typed:
        tests.append(v.typed["bool"]())
    if "str" in v.typed:
        tests.append(F.length(v.typed["str"]()) > 0)
    if "num" in v.typed:
        n = v.typed["num"]()
        tests.append((n != 0) & ~F.isnan(n.cast("double")))
    if not v.only:  # an unreadable boolean or number is false
        tests.append(F.when(v.datatype().isin(T.XSD + "boolean", *[T.XSD + n for n in T.NUMERIC]), False))
    return _first(tests)


Function = Callable[..., "Val | Column"]
_functions: dict[str, Function] = {}


def register_function(name: str, function: Function) -> None:
    """Makes an IRI callable in queries: the function gets a Val per argument and gives a Val or a column of strings."""
    _functions[T.iri(name)] = function


def register_python(name: str, function: Callable[..., str | None]) -> None:
    """The same for a Python function of terms to a term; an exception or None is an error. Runs on Arrow batches."""

    def call(*args: Val) -> Val:
        @F.pandas_udf(StringType())
        def batch(*columns: pd.Series) -> pd.Series:
            def one(*terms: str) -> str | None:
                try:
                    return None if any(t is None for t in terms) else function(*terms)
                except Exception:  # noqa: BLE001 an error of the expression
                    return None

            return pd.Series([one(*row) for row in zip(*columns, strict=True)], dtype=object)

        return _of_term(batch(*[a.term() for a in args]))

    register_function(name, call)


FN = "urn:quadflow:fn:"
register_function(FN + "equal", lambda a, b: _of_typed("bool", a.term() == b.term(), T.XSD + "boolean"))
register_function(FN + "lc", lambda a: _of_typed("str", F.when(a.kind() == "L", F.lower(a.text())), ""))
register_function(FN + "uc", lambda a: _of_typed("str", F.when(a.kind() == "L", F.upper(a.text())), ""))


def regex(text: Column, pattern: str, flags: str = "") -> Column:
    """A constant pattern; one without special characters becomes an equality or a substring test."""
    if not flags:
        inner = pattern.removeprefix("^")
        start = len(inner) < len(pattern)
        end = inner.endswith("$") and not inner.endswith("\\$")
        inner = inner[:-1] if end else inner
        if not _META.search(inner):
            if start and end:
                return text == inner
            if start:
                return text.startswith(inner)
            return text.endswith(inner) if end else text.contains(inner)
    marks = "".join(f for f in "smix" if f in flags)
    return text.rlike(f"(?{marks})" + pattern if marks else pattern)


def value(e: Expr, b: Bindings) -> Val:
    """The value of an expression over solutions."""
    if e.op == "var":
        name = e.args[0]
        if name not in b.forms:
            return Val(term=_null, kind=_null, text=_null, only=True, lang=_null, datatype=_null)
        return _of_variable(name, b)
    if e.op == "term":
        return _of_constant(e.args[0])
    if e.op in _OPS:
        return _of_typed("bool", compare(e.op, value(e.args[0], b), value(e.args[1], b)), T.XSD + "boolean")
    if e.op in ("&&", "||", "!"):
        parts = [truth(value(x, b)) for x in e.args]
        return _of_typed("bool", ~parts[0] if e.op == "!" else parts[0] & parts[1] if e.op == "&&" else parts[0] | parts[1], T.XSD + "boolean")
    if e.op in ("+", "-", "*", "/", "neg"):
        nums = [v.typed["num"]() if "num" in (v := value(x, b)).typed else _null("double") for x in e.args]
        if e.op == "neg":
            return _of_typed("num", -nums[0], T.XSD + "decimal")
        x, y = nums
        if e.op == "/":
            out = F.when(F.typeof(x).isin("double", "float") | F.typeof(y).isin("double", "float"), F.when(y == 0, F.when(x == 0, F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(F.try_divide(x.cast("double"), y.cast("double")))).otherwise(F.try_divide(x.cast("double"), y.cast("double")))
        else:
            out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[e.op](x, y)
        return _of_typed("num", out, T.XSD + "decimal")
    name, *args = e.args
    if name == "BOUND":
        n = args[0].args[0]
        if n not in b.forms:
            return _of_typed("bool", F.lit(False), T.XSD + "boolean")
        return _of_typed("bool", F.lit(True) if n in b.certain else F.col(f"`{column(n)}`").isNotNull(), T.XSD + "boolean")
    vals = [value(x, b) for x in args]
    yes = lambda c: _of_typed("bool", c, T.XSD + "boolean")
    if name in ("ISIRI", "ISURI"):
        return yes(vals[0].kind() == "U")
    if name == "ISBLANK":
        return yes(vals[0].kind() == "B")
    if name == "ISLITERAL":
        return yes(vals[0].kind() == "L")
    if name == "STR":
        return _of_typed("str", F.when(vals[0].kind() != "B", vals[0].text()), "")
    if name == "LANG":
        return _of_typed("str", vals[0].lang(), "")
    if name == "DATATYPE":
        d = vals[0].datatype()
        return Val(term=lambda: T.c_iri(d), kind=lambda: F.when(d.isNotNull(), "U"), text=lambda: d, only=True, lang=_null, datatype=_null)
    if name == "SAMETERM":
        return yes(vals[0].term() == vals[1].term())
    if name == "LANGMATCHES":
        tag, want = (F.lower(v.typed["str"]()) if "str" in v.typed else _null() for v in vals)
        return yes(F.when(want == "*", tag != "").otherwise((tag == want) | tag.startswith(F.concat(want, F.lit("-")))))
    if name == "REGEX":
        text = vals[0].typed["str"]() if "str" in vals[0].typed else _null()
        if all(x.op == "term" for x in args[1:]):
            return yes(regex(text, *[T.parse_term(x.args[0]).value for x in args[1:]]))
        pattern = vals[1].typed["str"]() if "str" in vals[1].typed else _null()
        flags = vals[2].typed["str"]() if len(vals) > 2 and "str" in vals[2].typed else F.lit("")
        return yes(F.regexp_like(text, F.concat(F.when(flags == "", "").otherwise(F.concat(F.lit("(?"), flags, F.lit(")"))), pattern)))
    if name.startswith(f"<{T.XSD}"):
        return _cast(name[len(T.XSD) + 1 : -1], vals[0])
    if name in _functions:
        out = _functions[name](*vals)
        return out if isinstance(out, Val) else _of_typed("str", out, "")
    raise ValueError(f"unknown function {name}")


def _cast(to: str, v: Val) -> Val:
    text = F.when(v.kind() == "L", v.text())
    datatype = T.XSD + to
    if to == "string":
        return _of_typed("str", F.when(v.kind() != "B", v.text()), datatype)
    if to == "boolean":
        number = [v.typed["num"]() != 0] if "num" in v.typed else []
        return _of_typed("bool", _first([T.c_boolean(text), *number]), datatype)
    if to in ("dateTime", "date"):
        return _of_typed("time", text.try_cast("timestamp"), datatype)
    truths = [F.when(v.typed["bool"](), 1).otherwise(F.when(~v.typed["bool"](), 0))] if "bool" in v.typed else []
    if to in ("float", "double"):
        return _of_typed("num", _first([c.cast("double") for c in ([v.typed["num"]()] if v.only and "num" in v.typed else [T.c_double(text)])] + [c.cast("double") for c in truths]), datatype)
    if to in (*T.INTEGERS, "decimal"):
        # numbers and truths by value, cut off towards zero for integers; other literals by their text, which must be one
        if v.only and "num" in v.typed:
            number = v.typed["num"]().try_cast("decimal(38,18)")
        elif v.typed:
            value_ = F.coalesce(_exact(text)[0], v.typed["num"]().try_cast("decimal(38,18)")) if "num" in v.typed else _null("decimal(38,18)")
            number = F.coalesce(F.when(v.typed["num"]().isNotNull(), value_) if "num" in v.typed else value_, *[c.cast("decimal(38,18)") for c in truths])
        else:
            number = _null("decimal(38,18)")
        lexical = text.rlike(r"^\s*[+-]?[0-9]+\s*$") if to != "decimal" else text.rlike(r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\s*$")
        number = F.coalesce(number, F.when(lexical, _exact(text)[0]))
        whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
        return _of_typed("num", whole if to != "decimal" else number, datatype)
    raise ValueError(f"no cast to {to}")


def condition(e: Expr, b: Bindings) -> Column:
    return truth(value(e, b))


def conjuncts(e: Expr) -> list[Expr]:
    return [y for x in e.args for y in conjuncts(x)] if e.op == "&&" else [e]


def sort_keys(e: Expr, ascending: bool, b: Bindings) -> list[Column]:
    """Unbound, then blank nodes, IRIs and literals; literals of one type by value, then all by text and term."""
    v = value(e, b)
    order = (lambda c: c.asc_nulls_first()) if ascending else (lambda c: c.desc_nulls_last())
    if v.only and len(v.typed) == 1:
        return [order(next(iter(v.typed.values()))())]
    kind = v.kind()
    keys = [order(F.when(kind == "B", 1).when(kind == "U", 2).when(kind == "L", 3).otherwise(0))]
    if v.typed:
        typed = [(t, v.typed[t]()) for t in ("num", "time", "bool", "str") if t in v.typed]
        keys.append(order(reduce(lambda acc, x: acc.when(x[1][1].isNotNull(), x[0]), enumerate(typed), F.when(F.lit(False), 0)).otherwise(len(typed))))
        keys += [order(c) for t, c in typed if t != "str"]
    return [*keys, order(v.text()), order(v.term())]
