"""Sources written in Python: a function of a template that yields statements, read as a Spark data source."""

from __future__ import annotations

import importlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, WriterCommitMessage

from quadflow.functions import terms as T


class StatementSource(DataSource):
    """Option "function": module:name of select(s, p, o, g) -> tuples; parts that a query fixes are handed to it, None
    stands for any. What it yields is checked against them again."""

    @classmethod
    def name(cls) -> str:
        return "quadflow-statements"

    def schema(self) -> str:
        return "s string, p string, o string, g string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001, ARG002
        return _Reader(self.options["function"])


class _Reader(DataSourceReader):
    def __init__(self, function: str) -> None:
        self.function = function
        self.template: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in "spog":
                self.template[f.attribute[0]] = f.value
            yield f  # checked again

    def read(self, partition) -> Iterator[tuple]:  # noqa: ANN001, ARG002
        module, _, name = self.function.partition(":")
        select = getattr(importlib.import_module(module), name)
        for row in select(*[self.template.get(k) for k in "spog"]):
            yield (*row, "") if len(row) == 3 else tuple(row)


def python_source(spark: SparkSession, function: str) -> DataFrame:
    """Quads of a Python function, "module:name"."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StatementSource)
    return spark.read.format("quadflow-statements").option("function", function).load().select("*", *T.c_parts(F.col("o")))


@dataclass
class _Told(WriterCommitMessage):
    rows: int


class StatementSink(DataSource):
    """Option "function": module:name of sink(rows), called once per partition with an iterator of (s, p, o, g) tuples on
    the executors; an optional module:name in "done" is called on the driver with the number of rows when all are in."""

    @classmethod
    def name(cls) -> str:
        return "quadflow-sink"

    def writer(self, schema, overwrite) -> DataSourceWriter:  # noqa: ANN001, ARG002
        return _Writer(self.options["function"], self.options.get("done"))


def _named(function: str):  # noqa: ANN202
    module, _, name = function.partition(":")
    return getattr(importlib.import_module(module), name)


class _Writer(DataSourceWriter):
    def __init__(self, function: str, done: str | None) -> None:
        self.function, self.done = function, done

    def write(self, rows: Iterator) -> WriterCommitMessage:
        count = 0

        def each() -> Iterator[tuple]:
            nonlocal count
            for r in rows:
                count += 1
                yield tuple(r)

        _named(self.function)(each())
        return _Told(count)

    def commit(self, messages: list) -> None:
        if self.done:
            _named(self.done)(sum(m.rows for m in messages if m is not None))


def python_sink(quads: DataFrame, function: str, done: str | None = None) -> None:
    """Hands quads to a Python function, "module:name", a partition at a time."""
    quads.sparkSession.dataSource.register(StatementSink)
    writer = quads.select("s", "p", "o", "g").write.format("quadflow-sink").option("function", function).mode("append")
    (writer.option("done", done) if done else writer).save()
