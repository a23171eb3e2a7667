"""Filters of literals: comparison, substring and value tests on an object's text."""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadflow.functions import terms as T

_OPS = {"<": Column.__lt__, "<=": Column.__le__, "!=": Column.__ne__, "=": Column.__eq__, ">": Column.__gt__, ">=": Column.__ge__}


def _compare(a: Column, op: str, b: Column) -> Column:
    return F.coalesce(_OPS[op](a, b), F.lit(False))


class LiteralFilter:
    """condition() is false for everything but literals that pass."""

    def condition(self, kind: Column, value: Column) -> Column:
        return (kind == "L") & self.test(value)

    def test(self, value: Column) -> Column:
        raise NotImplementedError

    @staticmethod
    def create(op: str, value: object) -> LiteralFilter:
        """The filter for a comparison with a native value."""
        if isinstance(value, bool):
            return BooleanCompare(op, value)
        if isinstance(value, (int, float, decimal.Decimal)):
            return NumericCompare(op, decimal.Decimal(str(value)))
        if isinstance(value, (dt.datetime, dt.date)):
            return DateTimeCompare(op, value)
        if isinstance(value, dt.timedelta):
            return DurationCompare(op, value)
        if isinstance(value, str):
            return StringCompare(op, value)
        raise TypeError(f"no filter for {type(value).__name__}")


@dataclass(frozen=True)
class StringCompare(LiteralFilter):
    """By code points."""

    op: str
    value: str

    def test(self, value: Column) -> Column:
        return _compare(value, self.op, F.lit(self.value))


@dataclass(frozen=True)
class StringContains(LiteralFilter):
    value: str

    def test(self, value: Column) -> Column:
        return F.coalesce(value.contains(self.value), F.lit(False))


@dataclass(frozen=True)
class StringStartsWith(LiteralFilter):
    value: str

    def test(self, value: Column) -> Column:
        return F.coalesce(value.startswith(self.value), F.lit(False))


@dataclass(frozen=True)
class StringEndsWith(LiteralFilter):
    value: str

    def test(self, value: Column) -> Column:
        return F.coalesce(value.endswith(self.value), F.lit(False))


@dataclass(frozen=True)
class NumericCompare(LiteralFilter):
    """The text as a decimal number, whatever the datatype; text with an exponent or that is no number fails every test.
    Thousands may be set off by commas."""

    op: str
    value: decimal.Decimal

    def test(self, value: Column) -> Column:
        number = F.when(value.rlike(r"^\s*[+-]?[0-9][0-9,]*(\.[0-9]*)?\s*$|^\s*[+-]?\.[0-9]+\s*$"), F.replace(F.trim(value), F.lit(","), F.lit("")).try_cast("decimal(38,18)"))
        return _compare(number, self.op, F.lit(str(self.value)).cast("decimal(38,18)"))


@dataclass(frozen=True)
class BooleanCompare(LiteralFilter):
    op: str
    value: bool

    def test(self, value: Column) -> Column:
        return _compare(T.c_boolean(value), self.op, F.lit(self.value))


@dataclass(frozen=True)
class DateTimeCompare(LiteralFilter):
    op: str
    value: dt.datetime | dt.date

    def test(self, value: Column) -> Column:
        return _compare(value.try_cast("timestamp"), self.op, F.lit(self.value.isoformat()).try_cast("timestamp"))


@dataclass(frozen=True)
class DurationCompare(LiteralFilter):
    op: str
    value: dt.timedelta

    def test(self, value: Column) -> Column:
        return _compare(T.c_seconds(value), self.op, F.lit(self.value.total_seconds()))
