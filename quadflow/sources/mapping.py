"""Ordinary tables as statements, without materializing one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadflow.functions import terms as T
from quadflow.operators.bindings import Form
from quadflow.operators.store import QuadStore, TableSource
from quadflow.runtime import state, table
from quadflow.sources.dictionary import DictionarySource

EX = "http://ex.org/"
XSD_OF = {"int": "int", "bigint": "long", "smallint": "short", "tinyint": "byte", "double": "double", "float": "float", "boolean": "boolean", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "date": "date"}


def mapped(df: DataFrame, name: str, key: str | None, links: dict[str, tuple[str, str]] | None = None, base: str = EX, lang: str | None = None, graph: str | None = None) -> TableSource:
    """A table's rows as subjects <base/name/key>, of class <base/Name>, with a statement per column that is not null.

    key None: the subject is a blank node labelled by the row's hash. links: column -> (predicate, table) makes a further
    statement that points at the other table's subject. Columns of arrays, maps and structs are not mapped. lang tags
    the text columns; graph is a column whose values <base/column/value> name the rows' graphs.
    """
    types = dict(df.dtypes)
    if key is None:
        subject, form = F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])), Form("bnode", "B")
    else:
        subject, form = F.col(key), Form("iri", "U", prefix=f"{base}{name}/", type=types[key])
    columns: dict[str, tuple[Column, Form]] = {}
    for c, t in df.dtypes:
        if t == "timestamp_ntz":
            columns[T.iri(base + c)] = (F.col(c).cast("timestamp"), Form("literal", "L", datatype=T.XSD + "dateTime", type="timestamp"))
        elif t == "string":
            columns[T.iri(base + c)] = (F.col(c), Form("literal", "L", lang=lang))
        elif t in XSD_OF or t.startswith("decimal"):
            columns[T.iri(base + c)] = (F.col(c), Form("literal", "L", datatype=T.XSD + XSD_OF.get(t, "decimal"), type=t))
    for c, (predicate, other) in (links or {}).items():
        columns[T.iri(base + predicate)] = (F.col(c), Form("iri", "U", prefix=f"{base}{other}/", type=types[c]))
    g = None if graph is None else (F.col(graph), Form("iri", "U", prefix=f"{base}{graph}/", type=types[graph]))
    return TableSource(df if graph is None else df.where(F.col(graph).isNotNull()), subject, form, T.iri(base + name.capitalize()), columns, g)


#: table -> (key, column -> (predicate, table))
TABLES: dict[str, tuple[str | None, dict[str, tuple[str, str]]]] = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {"n_regionkey": ("n_region", "region")}),
    "customer": ("c_custkey", {"c_nationkey": ("c_nation", "nation")}),
    "supplier": ("s_suppkey", {"s_nationkey": ("s_nation", "nation")}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"o_custkey": ("o_customer", "customer")}),
    "lineitem": (None, {"l_orderkey": ("l_order", "orders"), "l_partkey": ("l_part", "part"), "l_suppkey": ("l_supplier", "supplier")}),
    "events": ("event_id", {"user_id": ("user", "customer")}),
    "documents": ("doc_id", {}),
    "page_labels": (None, {"doc_id": ("page", "documents")}),
}


def mapped_store(spark: SparkSession, sf_dir: str, tables: list[str] | None = None) -> QuadStore:
    """The star schema as one store; rows of page_labels are blank nodes that point at their page."""
    store = QuadStore(spark)
    for name in tables or TABLES:
        key, links = TABLES[name]
        store = store.add_source(mapped(table(spark, sf_dir, name), name, key, links))
    return store


_opened: dict[tuple[str, str], tuple[tuple, QuadStore]] = {}


def rdf_store(spark: SparkSession, sf_dir: str) -> QuadStore:
    """The statements of a dictionary-encoded store, matched on ids (see DictionarySource). A folder whose files are as
    they were is opened once per application, so what was learned about its dictionaries is kept."""
    names = [f"rdf_{n}" for n in ("statements", "entities", "bnodes", "literals")]
    key, now = (spark.sparkContext.applicationId, sf_dir), state(spark, [f"{sf_dir}/{n}.parquet" for n in names])
    if key not in _opened or _opened[key][0] != now:
        _opened[key] = (now, QuadStore(spark, [DictionarySource(*[table(spark, sf_dir, n) for n in names])]))
    return _opened[key][1]
