"""Arithmetic relations of rule bodies, exact in decimals, over columns of terms in Arrow batches."""

from __future__ import annotations

import decimal
import math
import re
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadflow.functions import terms as T

#: Sums, differences and products are exact; quotients have 28 digits, functions of real numbers 15.
EXACT = decimal.Context(prec=1000, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)
QUOTIENT = decimal.Context(prec=28)
#: Numbers of more digits before or behind the point than this are none.
DIGITS = 400


def _real(function: Callable[..., float]) -> Callable[..., Decimal | None]:
    """A function of doubles, its value in 15 digits; None where it has none."""

    def run(*xs: Decimal) -> Decimal | None:
        try:
            value = function(*map(float, xs))
        except (ValueError, OverflowError, ZeroDivisionError):
            return None
        return Decimal(f"{value:.15g}") if isinstance(value, float) and math.isfinite(value) else None

    return run


def _whole(x: Decimal) -> Decimal:
    return x.to_integral_value(rounding=decimal.ROUND_FLOOR, context=EXACT)


#: subject -> object and, where there is one, object -> subject.
UNARY: dict[str, tuple[Callable, Callable | None]] = {
    "absoluteValue": (EXACT.abs, None),
    "cos": (_real(math.cos), _real(math.acos)),
    "sin": (_real(math.sin), _real(math.asin)),
    "tan": (_real(math.tan), _real(math.atan)),
    "sinh": (_real(math.sinh), None),
    "tanh": (_real(math.tanh), None),
    "degrees": (_real(math.radians), _real(math.degrees)),  # the subject's degrees in radians
    "equalTo": (lambda x: x, lambda x: x),
    "negation": (EXACT.minus, EXACT.minus),
    "rounded": (_whole, None),  # down
}
#: Of a list of two.
PAIR: dict[str, Callable] = {
    "atan2": _real(math.atan2),
    "difference": EXACT.subtract,
    "exponentiation": _real(math.pow),
    "integerQuotient": lambda a, b: _whole(QUOTIENT.divide(a, b)) if b else None,
    "quotient": lambda a, b: QUOTIENT.divide(a, b) if b else None,
    "remainder": lambda a, b: EXACT.remainder(a, b) if b else None,  # the sign is the dividend's
}


def _fold(step: Callable, start: int) -> Callable:
    def run(*xs: Decimal) -> Decimal:
        out = Decimal(start)
        for x in xs:
            out = step(out, x)
        return out

    return run


#: Of a list of any length.
FOLD: dict[str, Callable] = {"sum": _fold(EXACT.add, 0), "product": _fold(EXACT.multiply, 1)}
#: Tests of subject and object.
TEST: dict[str, Callable] = {
    "greaterThan": lambda a, b: a > b,
    "lessThan": lambda a, b: a < b,
    "notGreaterThan": lambda a, b: a <= b,
    "notLessThan": lambda a, b: a >= b,
    "notEqualTo": lambda a, b: a != b,
}

#: Relations of the user's own, by IRI: subject terms -> object term and, if there is one, object term -> subject term.
CUSTOM: dict[str, tuple[Callable[..., Column], Callable[[Column], Column] | None]] = {}


def register_relation(name: str, forward: Callable[..., Column], reverse: Callable[[Column], Column] | None = None) -> None:
    """Makes an IRI a relation of rule bodies. forward gets a column of terms per argument, reverse the object's; both
    give a column of terms, null where the relation does not hold."""
    CUSTOM[T.iri(name)] = (forward, reverse)


def name_of(predicate: str) -> str | None:
    """The relation a predicate names, if it is one."""
    if predicate in CUSTOM:
        return predicate
    name = predicate[len(T.MATH) + 1 : -1] if predicate.startswith(f"<{T.MATH}") else ""
    return name if name in UNARY or name in PAIR or name in FOLD or name in TEST else None


_NUMBER = re.compile(r"\s*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]{1,5})?)\s*")


def number(term: str | None) -> Decimal | None:
    """A literal's number whatever its datatype, a double's in 15 digits; None for other terms and texts."""
    if not term or term[0] != '"':
        return None
    t = T.parse_term(term)
    m = _NUMBER.fullmatch(t.value)
    if not m:
        return None
    value = Decimal(m[1])
    if t.datatype in (T.XSD + "double", T.XSD + "float"):
        x = float(value)
        return Decimal(f"{x:.15g}") if math.isfinite(x) else None
    return value if -DIGITS < value.adjusted() < DIGITS and len(value.as_tuple().digits) < DIGITS else None


def number_term(x: Decimal | None) -> str | None:
    """The literal of a number: an integer where it is whole, else a decimal without idle zeros; None for no number."""
    if x is None or not x.is_finite():
        return None
    text = format(x, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    text = "0" if text in ("-0", "") else text
    return f'"{text}"^^<{T.XSD}{"decimal" if "." in text else "integer"}>'


def _batches(function: Callable, kind: str) -> Callable[..., Column]:
    """A function of numbers as one of columns of terms; null where an argument is no number."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        seen: dict[str | None, Decimal | None] = {}

        def read(term: str | None) -> Decimal | None:
            if term not in seen:
                if len(seen) > 100_000:
                    seen.clear()
                seen[term] = number(term)
            return seen[term]

        out = []
        for row in zip(*columns, strict=True):
            xs = [read(t) for t in row]
            value = None if any(x is None for x in xs) else function(*xs)
            out.append(number_term(value) if kind == "string" else value)
        return pd.Series(out, dtype=object)

    return run


def relation(name: str, args: list[Column]) -> Column:
    """The object's term of a relation with these subjects, null where there is none."""
    function = UNARY[name][0] if name in UNARY else PAIR.get(name) or FOLD[name]
    return _batches(function, "string")(*args) if args else F.lit(number_term(function()))


def reverse(name: str, out: Column) -> Column | None:
    """The subject's term of a relation with this object."""
    back = UNARY[name][1] if name in UNARY else None
    return None if back is None else _batches(back, "string")(out)


def test(name: str, a: Column, b: Column) -> Column:
    return F.coalesce(_batches(TEST[name], "boolean")(a, b), F.lit(False))


def same(a: Column, b: Column) -> Column:
    """Whether two terms are one number."""
    return F.coalesce(_batches(lambda x, y: x == y, "boolean")(a, b), F.lit(False))
