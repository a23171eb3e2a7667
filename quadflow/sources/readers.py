"""Documents as quads."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadflow.functions import terms as T
from quadflow.operators.store import QuadSource
from quadflow.sources import n3, rdfxml

#: One line of N-Triples or N-Quads: subject, predicate, object, graph.
#: A statement whose literal has no quote inside, as of _guarded(): a loop over one class of characters takes no stack,
#: however long the text.
_LINE = r"^[ \t]*(<[^<>\s]*>|_:\S+)[ \t]*(<[^<>\s]*>)[ \t]*(<[^<>\s]*>|_:[^\s.]+(?:\.+[^\s.]+)*|\"[^\"]*\"(?:@[A-Za-z0-9-]+|\^\^<[^<>\s]*>)?)[ \t]*(<[^<>\s]*>|_:[^\s.]+)?[ \t]*\.[ \t]*(?:#.*)?\r?$"
_MARKS = ("\x01\ue002", "\x01\ue003")
FORMATS = {
    "nt": "nt", "ntriples": "nt", "nq": "nt", "nquads": "nt", "n3": "n3", "turtle": "n3", "ttl": "n3", "xml": "xml", "rdf": "xml", "rdfxml": "xml", "owl": "xml",
    "text/plain": "nt", "application/n-triples": "nt", "application/n-quads": "nt", "text/n3": "n3", "text/rdf+n3": "n3", "application/n3": "n3", "text/turtle": "n3", "application/turtle": "n3", "application/x-turtle": "n3",
    "application/rdf+xml": "xml", "text/xml": "xml", "application/xml": "xml", "text/rdf": "xml",
}


@dataclass
class Document:
    """quads, and rejects: (file, line, error, text) of lines or files that do not parse and literals with bad texts."""

    quads: DataFrame
    rejects: DataFrame


def format_of(path: str, given: str | None = None) -> str:
    """nt, n3 or xml, from a name, a MIME type (parameters are ignored) or a path's extension."""
    name = (given or path.rstrip("/").removesuffix(".gz").rpartition(".")[2]).split(";")[0].strip().lower()
    if name not in FORMATS:
        raise ValueError(f"unknown format {name}")
    return FORMATS[name]


def sniffed(spark: SparkSession, path: str) -> str:
    """nt, n3 or xml by the first line that is neither empty nor a comment."""
    first = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$")).select(F.regexp_replace("value", "^\ufeff", "").alias("value")).first()
    line = "" if first is None else first["value"].lstrip()
    if line.startswith(("<?xml", "<!DOCTYPE", "<!--", "<rdf:RDF")):
        return "xml"
    return "nt" if re.match(_LINE, line.replace("\\\\", _MARKS[0]).replace('\\"', _MARKS[1])) else "n3"


def _decoder(n: int, charset: str):  # noqa: ANN202
    """For the parts of a text between escapes: every one but the first begins with n hexadecimal digits."""
    return lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.decode(F.unhex(x.substr(F.lit(1), F.lit(n))), charset), x.substr(F.lit(n + 1), F.length(x))))


def _unicode(text: Column) -> Column:
    """Text with \\uXXXX and \\UXXXXXXXX as the characters they stand for; an escaped backslash before u stays one."""
    mark = F.lit("\x01\ue001")
    safe = F.replace(text, F.lit("\\\\"), mark)
    for sign, n, charset in (("\\\\u", 4, "UTF-16BE"), ("\\\\U", 8, "UTF-32")):
        safe = F.array_join(F.transform(F.split(safe, sign), _decoder(n, charset)), "")
    return F.replace(safe, mark, F.lit("\\\\"))


def _canonical(object_: Column) -> Column:
    """A literal as canonical text: unusual escapes undone."""
    plain = F.regexp_extract(object_, r'(?s)^"(.*)"(@[A-Za-z0-9-]+|\^\^<[^>"]*>)?$', 1)
    tail = F.regexp_extract(object_, r'(?s)^"(.*)"(@[A-Za-z0-9-]+|\^\^<[^>"]*>)?$', 2)
    text = plain
    for a, b in (("\\b", "\b"), ("\\f", "\f"), ("\\'", "'")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.when(object_.startswith('"') & object_.contains("\\"), F.concat(F.lit('"'), T.c_escape(T.c_unescape(_unicode(text))), F.lit('"'), tail)).otherwise(object_)


def _guarded(line: Column) -> Column:
    """A line with marks for escaped backslashes and quotes."""
    return F.replace(F.replace(line, F.lit("\\\\"), F.lit(_MARKS[0])), F.lit('\\"'), F.lit(_MARKS[1]))


def _unguarded(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_MARKS[1]), F.lit('\\"')), F.lit(_MARKS[0]), F.lit("\\\\"))


def lines_as_quads(lines: DataFrame, graph: str | None = None, scope: str | None = None) -> Document:
    """N-Triples or N-Quads from a DataFrame of lines (value), every line by itself, without Python.

    scope goes before blank nodes' labels; without one they differ between files. Empty lines and comments are skipped.
    """
    file = F.input_file_name()
    guarded = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$")).select("value", _guarded(F.col("value")).alias("line"), file.alias("file"))
    split = F.split(F.regexp_replace("line", _LINE, "$1\x1f$2\x1f$3\x1f$4"), "\x1f")
    rows = guarded.select("value", F.when(F.col("line").rlike(_LINE), split).alias("x"), "file")
    prefix = F.substring(F.sha1("file"), 1, 8) if scope is None else F.lit(scope)
    node = lambda c: F.when(c.startswith("_:"), F.concat(F.lit("_:"), prefix, c.substr(F.lit(3), F.length(c)))).when(c.contains("\\"), _unicode(c)).otherwise(c)
    x = F.col("x")
    g = F.lit(graph) if graph else node(F.coalesce(x[3], F.lit("")))
    good = rows.where("x is not null").select(node(x[0]).alias("s"), node(x[1]).alias("p"), F.when(x[2].startswith('"'), _canonical(_unguarded(x[2]))).otherwise(node(x[2])).alias("o"), g.alias("g"), "file")
    quads = good.select("s", "p", "o", "g", *T.c_parts(F.col("o")))
    bad = rows.where("x is null").select("file", F.lit(None).cast("bigint").alias("line"), F.lit("the line is no statement").alias("error"), F.col("value").alias("text"))
    return Document(quads, bad.unionByName(invalid_literals(quads)))


def invalid_literals(quads: DataFrame) -> DataFrame:
    """(file, line, error, text) of literals whose text is no lexical form of their XML Schema datatype."""
    short, v = F.regexp_extract("o_dt", f"^{T.XSD}([A-Za-z]+)$", 1), F.trim("o_val")
    bad = (
        F.when(short == "boolean", ~v.isin("true", "false", "0", "1"))
        .when(short.isin(*T.INTEGERS), ~v.rlike("^[+-]?[0-9]+$"))
        .when(short == "decimal", ~v.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"))
        .when(short.isin("float", "double"), T.c_double(v).isNull())
        .when(short.isin("dateTime"), ~v.rlike(r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}") | v.try_cast("timestamp").isNull())
        .when(short == "date", v.substr(1, 10).try_cast("date").isNull())
        .when(short == "duration", T.c_seconds(v).isNull())
        .otherwise(False)
    )
    return quads.where("o_dt is not null").where(bad).select(F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("line"), F.concat(F.lit("no lexical form of "), "o_dt").alias("error"), F.col("o").alias("text"))


def _naming(lines: DataFrame, wants: dict[str, str | list[str]]) -> DataFrame:
    """Without lines that can't match a template: those that neither name its IRIs nor have an escape."""
    for want in wants.values():
        terms = [want] if isinstance(want, str) else want
        if 0 < len(terms) <= 50 and all(t.startswith("<") and t != T.RDFS_MEMBER for t in terms):
            lines = lines.where(reduce(lambda a, b: a | b, [F.col("value").contains(t) for t in [*terms, "\\"]]))
    return lines.where(F.spark_partition_id() >= 0)  # no later filter is merged with these, which would be slower


class LinesSource(QuadSource):
    """N-Triples or N-Quads as a source; a select drops lines that can't match before any is taken apart."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(read_rdf(spark, path, "nt").quads, distinct=False)
        self.spark, self.path = spark, path

    def select(self, wants: dict[str, str | list[str]]) -> DataFrame:
        return lines_as_quads(_naming(self.spark.read.text(self.path), wants), None, _scope(self.path)).quads


def _scope(path: str) -> str:
    """A folder or pattern is one document: its files were written together and share their blank nodes."""
    return hashlib.sha1(path.encode()).hexdigest()[:8]


def read_rdf(spark: SparkSession, paths: str | list[str], format: str | None = None, base: str | None = None, graph: str | None = None, validate: bool = True) -> Document:  # noqa: A002
    """Quads of documents; several paths, folders and patterns are read together.

    N-Triples and N-Quads are split at lines, whatever a file's size; Turtle, N3 and RDF/XML take one task a file. graph
    puts all statements into one graph; base resolves relative IRIs, else the file's own address does. Without a format,
    one that neither the extension tells is told by the first line, as it always is with "auto". What a parser left out
    with a warning is among the rejects.
    """
    paths = [paths] if isinstance(paths, str) else paths
    kinds: dict[str, list[str]] = {}
    for p in paths:
        known = format is not None or p.rstrip("/").removesuffix(".gz").rpartition(".")[2].lower() in FORMATS
        kinds.setdefault(format_of(p, format) if known and format != "auto" else sniffed(spark, p), []).append(p)
    found = []
    for kind, some in kinds.items():
        if kind == "nt":
            found += [lines_as_quads(spark.read.text(p), graph, _scope(p)) for p in some]
        else:
            found.append(_whole(spark, some, kind, base, graph, validate))
    return Document(reduce(DataFrame.unionByName, [d.quads for d in found]), reduce(DataFrame.unionByName, [d.rejects for d in found]))


def _whole(spark: SparkSession, paths: list[str], kind: str, base: str | None, graph: str | None, validate: bool) -> Document:
    texts = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                scope = hashlib.sha1(file.encode()).hexdigest()[:8]
                try:
                    notes: list[str] = []
                    if kind == "n3":
                        parser = n3.Parser(text, base or file, graph or "", scope)
                        rows, notes = parser.parse(), parser.warnings
                    else:
                        rows = rdfxml.parse(text, base or file, graph or "", scope)
                    yield pd.DataFrame([(*r, file, None) for r in rows] + [(None, None, None, None, file, w) for w in notes], columns=["s", "p", "o", "g", "file", "error"], dtype=object)
                except n3.RdfError as e:
                    yield pd.DataFrame([(None, None, None, None, file, str(e))], columns=["s", "p", "o", "g", "file", "error"], dtype=object)

    from quadflow.runtime import written

    parsed = written(texts.mapInPandas(run, "s string, p string, o string, g string, file string, error string"), "parsed")
    quads = parsed.where("error is null").select("s", "p", "o", "g", *T.c_parts(F.col("o")))
    bad = parsed.where("error is not null").select("file", F.regexp_extract("error", "^line ([0-9]+)", 1).try_cast("bigint").alias("line"), "error", F.lit(None).cast("string").alias("text"))
    return Document(quads, bad.unionByName(invalid_literals(quads)) if validate else bad)


def read_jdbc(spark: SparkSession, url: str, prefix: str = "", **options: str) -> DataFrame:
    """Quads of a dictionary-encoded store in a relational database: prefix_statements, _literals and _entities.

    The driver's class must be on Spark's class path; options go to the JDBC source.
    """
    get = lambda t: spark.read.format("jdbc").options(url=url, dbtable=f"{prefix}{t}", **options).load()
    return decoded(get("_statements"), get("_entities"), get("_literals"))


def decoded(statements: DataFrame, entities: DataFrame, literals: DataFrame) -> DataFrame:
    """Quads of the three tables (subject, predicate, objecttype, object, meta), (id, value) and (id, value, language,
    datatype); an id without an entity is a blank node; meta 1 is the default graph. Of an id's rows the latest counts."""
    from quadflow.sources.dictionary import dictionary_source

    return dictionary_source(statements.sparkSession, statements, entities, literals).quads()
