"""Stores from text: what to read, and reasoners in front."""

from __future__ import annotations

import importlib

from pyspark.sql import SparkSession

from quadflow.operators.store import QuadSource, QuadStore
from quadflow.reason.rdfs import RDFS
from quadflow.reason.rules import RuleEngine
from quadflow.sources import n3
from quadflow.sources.custom import python_source
from quadflow.sources.mapping import mapped_store, rdf_store
from quadflow.sources.readers import FORMATS, LinesSource, read_jdbc, read_rdf
from quadflow.sources.writers import write_rdf


def open_store(spark: SparkSession, spec: str) -> QuadStore:
    """A store of sources, one a line or parted by |: FORMAT:path (nt, n3, turtle, xml, ...), parquet:path of quads,
    tables:folder (the star schema), rdf:folder (the dictionary-encoded tables), jdbc:url, python:module:function,
    class:module:name (called with the session, it gives quads or a store), mem or null (nothing).

    In front may stand rdfs+SCHEMA+ and rules+RULES+, each with a source or a path of its own, and debug+. A source
    may end with "@<iri>", which names its graph.
    """
    spec = spec.strip()
    if spec.startswith("debug+"):
        return open_store(spark, spec[6:]).explained()
    if spec.startswith("rdfs+"):
        schema, _, rest = spec[5:].partition("+")
        return open_store(spark, rest).with_reasoner(RDFS(open_store(spark, schema).quads))
    if spec.startswith("rules+"):
        path, _, rest = spec[6:].partition("+")
        with open(path, encoding="utf-8") as f:
            rules, ground = n3.rules(n3.parse(f.read(), base=path))
        return open_store(spark, rest).with_reasoner(RuleEngine(rules, ground))
    store = QuadStore(spark)
    for one in spec.replace("|", "\n").split("\n"):
        if not (one := one.strip()):
            continue
        graph = None
        if one.endswith(">") and "@<" in one:
            one, _, graph = one.rpartition("@")
        kind, _, rest = one.partition(":")
        if kind in ("mem", "null"):
            continue
        if kind in FORMATS:
            source = LinesSource(spark, rest) if FORMATS[kind] == "nt" else QuadSource(read_rdf(spark, rest, kind).quads, distinct=False)
        elif kind == "parquet":
            source = QuadSource(spark.read.parquet(rest))
        elif kind in ("tables", "rdf"):
            source = mapped_store(spark, rest) if kind == "tables" else rdf_store(spark, rest)
        elif kind == "jdbc":
            source = QuadSource(read_jdbc(spark, one))
        elif kind == "python":
            source = QuadSource(python_source(spark, rest))
        elif kind == "class":
            module, _, name = rest.partition(":")
            source = getattr(importlib.import_module(module), name)(spark)
        else:
            raise ValueError(f"unknown source {one}")
        for s in source.sources if isinstance(source, QuadStore) else [source]:
            store = store.add_source(s, graph)
    return store


def save_store(store: QuadStore, spec: str, prefixes: dict[str, str] | None = None) -> int | None:
    """Writes a store: FORMAT:path, parquet:path, or null, which only counts. N-Triples and N-Quads, which name
    every subject again and again, become compressed files."""
    kind, _, path = spec.partition(":")
    if kind == "null":
        return store.count()
    if kind == "parquet":
        store.write(path)
    elif FORMATS.get(kind) == "nt":
        write_rdf(store.by_row(), path, kind, prefixes, compression="gzip")
    else:
        write_rdf(store.quads, path, kind, prefixes)
    return None
