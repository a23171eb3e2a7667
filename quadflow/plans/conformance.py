"""Queries that run readers, writers, result forms, filters, relations and tools over whole tables, and SQL that gives the
same rows."""

from __future__ import annotations

import contextlib
import datetime as dt
import gzip
import io
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadflow.functions import terms as T
from quadflow.functions.namespaces import Namespaces
from quadflow.operators import filters as L
from quadflow.operators.graph import connectivity, find_msg
from quadflow.operators.navigate import navigate
from quadflow.operators.store import QuadStore, quads_of
from quadflow.plans.algebra import Triple, Var
from quadflow.plans.expr import register_python
from quadflow.plans.planner import Planner
from quadflow.plans.queries import _TERMS, PREFIX, _rule_math
from quadflow.plans.sparql import parse
from quadflow.reason import mathrel
from quadflow.reason.rdfs import RDFS, SUB_CLASS
from quadflow.reason.rules import Call, Rule, RuleEngine
from quadflow.runtime import scratch, table
from quadflow.sources import results as R
from quadflow.sources.custom import python_sink, python_source
from quadflow.sources.mapping import EX, mapped, mapped_store, rdf_store
from quadflow.sources.protocol import SparqlServer, endpoint_store
from quadflow.sources.readers import lines_as_quads, read_jdbc, read_rdf
from quadflow.sources.spec import open_store, save_store
from quadflow.sources.writers import graphviz, write_rdf
from quadflow.streaming.ingest import stream_into, stream_quads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SPO, SPOG = ["s", "p", "o"], ["s", "p", "o", "g"]
TYPE = T.RDF_TYPE


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _line(spark: SparkSession, **values: object) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def _local(path: str) -> str:
    return "/" + path.split(":", 1)[-1].lstrip("/")


# readers and writers: what was written and read again is what the tables say
_STAR = f"""with q as (
  select '<{EX}nation/' || n_nationkey || '>' as s, unnest(['{TYPE}', '<{EX}n_nationkey>', '<{EX}n_name>', '<{EX}n_regionkey>', '<{EX}n_region>']) as p,
    unnest(['<{EX}Nation>', '"' || n_nationkey || '"^^<{T.XSD}int>', '"' || n_name || '"', '"' || n_regionkey || '"^^<{T.XSD}int>', '<{EX}region/' || n_regionkey || '>']) as o from nation
  union all select '<{EX}region/' || r_regionkey || '>', unnest(['{TYPE}', '<{EX}r_regionkey>', '<{EX}r_name>']), unnest(['<{EX}Region>', '"' || r_regionkey || '"^^<{T.XSD}int>', '"' || r_name || '"']) from region)
"""
_ESCAPED = "replace(replace(replace(replace(replace({}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
_PAGES = f"""with q as (select '<{EX}page/' || doc_id || '>' as s, '<{EX}text>' as p, '"' || {_ESCAPED.format("text")} || '"' as o, '<{EX}source/' || source || '>' as g from documents where text is not null and source is not null)
"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """The text of every page, in the graph of its newspaper."""
    docs = table(spark, d, "documents").where("text is not null and source is not null")
    iri = lambda kind, c: F.concat(F.lit(f"<{EX}{kind}/"), F.col(c).cast("string"), F.lit(">"))
    return quads_of(docs, iri("page", "doc_id"), F.lit(f"<{EX}text>"), T.c_literal(F.col("text")), iri("source", "source"))


def _star(spark: SparkSession, d: str) -> QuadStore:
    return mapped_store(spark, d, ["nation", "region"])


def _round_trip(quads: DataFrame, format: str, suffix: str = "", **options: object) -> DataFrame:  # noqa: A002
    spark = quads.sparkSession
    path = scratch(spark, "document") + suffix
    write_rdf(quads, _local(path) if format in ("n3", "xml", "dot") else path, format, {"": EX, "xsd": T.XSD}, **options)
    return read_rdf(spark, path, None if suffix else format).quads


_add("io_ntriples", lambda spark, d: _round_trip(_star(spark, d).quads, "nt").select(*SPO), _STAR + "select * from q")
_add("io_nquads_pages", lambda spark, d: _round_trip(_pages(spark, d), "nquads").select(*SPOG), _PAGES + "select * from q")
_add("io_turtle", lambda spark, d: _round_trip(_star(spark, d).quads, "turtle").select(*SPO), _STAR + "select * from q")
_add("io_turtle_pages", lambda spark, d: _round_trip(_pages(spark, d).withColumn("g", F.lit("")), "turtle").select(*SPO), _PAGES + "select s, p, o from q")
_add("io_n3", lambda spark, d: _round_trip(_star(spark, d).quads, "n3").select(*SPO), _STAR + "select * from q")
_add("io_rdfxml", lambda spark, d: _round_trip(_star(spark, d).quads, "xml").select(*SPO), _STAR + "select * from q")
_add("io_rdfxml_by_extension", lambda spark, d: _round_trip(_star(spark, d).quads, "xml", ".rdf").select(*SPO), _STAR + "select * from q")
_add("io_sniffed", lambda spark, d: _round_trip(_star(spark, d).quads, "turtle", ".unknown").select(*SPO), _STAR + "select * from q")


def _reified(spark: SparkSession, d: str) -> DataFrame:
    """Quads with graphs as triples about statements, read and put together again."""
    path = scratch(spark, "reified")
    write_rdf(_pages(spark, d), path, "nt", graphs="reify")
    q = read_rdf(spark, path, "nt").quads
    part = lambda n: q.where(F.col("p") == f"<{T.RDF}{n}>").select(F.col("s").alias("st"), F.col("o").alias(n[0]))
    g = q.where(F.col("p") == f"<{T.LOG}includes>").select(F.col("o").alias("st"), F.col("s").alias("g"))
    return part("subject").join(part("predicate"), "st").join(part("object"), "st").join(g, "st").select(*SPOG)


_add("io_reified", _reified, _PAGES + "select * from q")


def _graphviz(spark: SparkSession, d: str) -> DataFrame:
    rows = [tuple(r) for r in _star(spark, d).quads.select(*SPOG).where(F.col("p") == f"<{EX}n_region>").collect()]  # the nations, a fixed few
    text = graphviz(rows).splitlines()
    return _line(spark, edges=sum(" -> " in x for x in text), nodes=sum("shape=" in x for x in text))


_add("io_graphviz", _graphviz, "select cast((select count(*) from nation) as int) as edges, cast((select count(*) from nation) + (select count(distinct n_regionkey) from nation) as int) as nodes")


def _text_file(lines: DataFrame, suffix: str) -> str:
    """Lines as one document."""
    path = scratch(lines.sparkSession, "lines") + suffix
    lines.coalesce(1).write.text(path)
    return path


def _relative(spark: SparkSession, d: str) -> DataFrame:
    """A Turtle document of relative names, resolved by a base and put into a graph."""
    lines = table(spark, d, "part").select(F.concat(F.lit("<part/"), F.col("p_partkey"), F.lit('> <name> "'), F.col("p_name"), F.lit('" .')).alias("value"))
    return read_rdf(spark, _text_file(lines, ".ttl"), base=EX, graph="<urn:parts>").quads.select(*SPOG)


_add("io_base_and_graph", _relative, f"select '<{EX}part/' || p_partkey || '>' as s, '<{EX}name>' as p, '\"' || p_name || '\"' as o, '<urn:parts>' as g from part")


def _parts_as_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh size lacks the full stop, every fifth is no integer."""
    size = F.when(F.col("p_size") % 5 == 0, F.concat("p_size", F.lit(".5"))).otherwise(F.col("p_size").cast("string"))
    line = F.concat(F.lit("<urn:part:"), F.col("p_partkey"), F.lit('> <urn:size> "'), size, F.lit(f'"^^<{T.XSD}integer>'), F.when(F.col("p_size") % 7 == 0, "").otherwise(" ."))
    return table(spark, d, "part").select(line.alias("value"))


_BAD = f"""with l as (select '<urn:part:' || p_partkey || '> <urn:size> "' || v || '"^^<{T.XSD}integer>' || case when p_size % 7 = 0 then '' else ' .' end as line, '"' || v || '"^^<{T.XSD}integer>' as lit, p_size
  from (select *, case when p_size % 5 = 0 then p_size || '.5' else cast(p_size as varchar) end as v from part))
"""
_add("io_rejects", lambda spark, d: lines_as_quads(_parts_as_lines(spark, d)).rejects.select("error", "text"), _BAD + f"select 'the line is no statement' as error, line as text from l where p_size % 7 = 0 union all select 'no lexical form of {T.XSD}integer', lit from l where p_size % 7 <> 0 and p_size % 5 = 0")
_add("io_accepted", lambda spark, d: lines_as_quads(_parts_as_lines(spark, d)).quads.select("o_val"), "select case when p_size % 5 = 0 then p_size || '.5' else cast(p_size as varchar) end as o_val from part where p_size % 7 <> 0")


def _two_folders(spark: SparkSession, d: str) -> DataFrame:
    paths = [scratch(spark, "many") for _ in range(2)]
    for path, name in zip(paths, ("nation", "region"), strict=True):
        write_rdf(mapped_store(spark, d, [name]).quads, path, "nt")
    return read_rdf(spark, paths, "nt").quads.select(*SPO)


_add("io_several_documents", _two_folders, _STAR + "select * from q")


def _saved(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "saved")
    save_store(_star(spark, d), f"nt:{path}-nt")
    save_store(open_store(spark, f"nt:{path}-nt"), f"parquet:{path}-parquet")
    return open_store(spark, f"parquet:{path}-parquet @<urn:kept>".replace(" ", "")).select().select(*SPOG)


_add("io_store_specs", _saved, _STAR + "select *, '<urn:kept>' as g from q")
_add("spec_counts", lambda spark, d: _line(spark, n=save_store(open_store(spark, f"tables:{d}"), "null:")).select(F.col("n") > 0, "n").select((F.col("n") - open_store(spark, f"tables:{d}\nmem:").quads.where(F.col("p") != TYPE).count()).cast("bigint").alias("n_types")), "select " + " + ".join(f"(select count(*) from {t})" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "page_labels")) + " as n_types")


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """N-Triples files as a stream into a table."""
    folder, out = scratch(spark, "arriving"), scratch(spark, "arrived")
    write_rdf(_star(spark, d).quads, folder, "nt")
    stream_into(stream_quads(spark, folder), out, available_now=True).awaitTermination()
    return spark.read.parquet(out).select(*SPO)


_add("stream_ntriples", _streamed, _STAR + "select * from q")



def _bulk_loaded(tables: dict[str, DataFrame]) -> str:
    """The URL of a Derby database with these tables in the shared folder, for all executors to read.

    Derby lets one process at a time open a database that can be written. So the driver loads what the executors wrote as
    text, a file at a time, and closes the database; a folder in place of the lock file then tells every process that it
    is read-only.
    """
    spark = next(iter(tables.values())).sparkSession
    jvm, path = spark.sparkContext._jvm, _local(scratch(spark, "derby"))
    url = f"jdbc:derby:{path}"
    props = jvm.java.util.Properties()
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(DERBY)
    db = jvm.java.sql.DriverManager.getConnection(url + ";create=true", props)
    run = db.createStatement()
    run.execute("call syscs_util.syscs_set_database_property('derby.storage.pageReservedSpace', '0')")  # no row will grow
    for name, rows in tables.items():
        kinds = {"string": "clob", "int": "integer"}
        run.execute(f"create table {name} (" + ", ".join(f'"{c}" {kinds.get(t, t)}' for c, t in rows.dtypes) + ")")
        plain = {"string": lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")}
        fields = [F.coalesce(plain.get(t, lambda c: c.cast("string"))(F.col(c)), F.lit("")) for c, t in rows.dtypes]
        text = _local(scratch(spark, "load"))
        rows.select(F.concat_ws(",", *fields).alias("value")).write.text(f"file://{text}", compression="gzip")
        for part in sorted(x for x in os.listdir(text) if x.startswith("part-")):
            with gzip.open(f"{text}/{part}") as packed, open(f"{text}/now", "wb") as out:
                shutil.copyfileobj(packed, out)
            if os.path.getsize(f"{text}/now"):
                run.execute(f"call syscs_util.syscs_import_table(null, '{name.upper()}', '{text}/now', null, null, 'UTF-8', 0)")
        shutil.rmtree(text)
    run.close()
    db.close()
    with contextlib.suppress(Py4JJavaError):  # a database that was shut down says so by an error
        jvm.java.sql.DriverManager.getConnection(url + ";shutdown=true", props)
    for lock in ("db.lck", "dbex.lck"):
        if os.path.exists(f"{path}/{lock}"):
            os.remove(f"{path}/{lock}")
    os.mkdir(f"{path}/db.lck")
    return url


def _jdbc(spark: SparkSession, d: str) -> DataFrame:
    """The store's tables written to a relational database and read from there."""
    tables = {}
    for name in ("statements", "entities", "literals"):
        rows = table(spark, d, f"rdf_{name}")
        tables[f"rdf_{name}"] = rows.select("subject", "predicate", "objecttype", "object", "meta") if name == "statements" else rows.drop("hash", "removed_at")
    return read_jdbc(spark, _bulk_loaded(tables), "rdf", driver=DERBY).select(*SPOG)


#: The relational database that Spark brings along.
DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
_add("io_jdbc_store", _jdbc, _TERMS.replace("union all select distinct id, '_:b' || id from rdf_bnodes", "union all select x, '_:b' || x from (select subject as x from rdf_statements union select predicate from rdf_statements union select object from rdf_statements where objecttype = 0 union select meta from rdf_statements where meta <> 1) where x not in (select id from rdf_entities)").replace("join named p on", "join node p on") + "select s, p, o, g from quad")

# results
_REGIONS = "SELECT ?r ?name ?none { ?r :r_name ?name } ORDER BY ?name"


def _text_lines(format: str) -> Callable[[SparkSession, str], DataFrame]:  # noqa: A002
    def run(spark: SparkSession, d: str) -> DataFrame:
        text = R.formatted(_star(spark, d).query(PREFIX + _REGIONS), format)
        return spark.createDataFrame([(x,) for x in text.splitlines()], "line string")

    return run


_add("results_csv", _text_lines("csv"), f"select 'r,name,none' as line union all select '{EX}region/' || r_regionkey || ',' || r_name || ',' from region")
_add("results_answers", _text_lines("answers"), f"select 'R' || chr(9) || 'NAME' || chr(9) || 'NONE' as line union all select '{EX}region/' || r_regionkey || chr(9) || r_name || chr(9) from region")
_add("results_text", _text_lines("simple"), f"select '?r = <{EX}region/' || r_regionkey || '>; ?name = \"' || r_name || '\"' as line from region")
_add("results_html", _text_lines("html"), f"select unnest(['<table>', '<tr><th>r</th><th>name</th><th>none</th></tr>', '</table>']) as line union all select '<tr><td>{EX}region/' || r_regionkey || '</td><td>' || r_name || '</td><td></td></tr>' from region")
_add("results_xml", lambda spark, d: R.from_results_xml(spark, R.formatted(_star(spark, d).query(PREFIX + "SELECT ?n ?name ?key { ?n :n_name ?name ; :n_nationkey ?key }"), "xml")), f"""select '<{EX}nation/' || n_nationkey || '>' as n, '"' || n_name || '"' as name, '"' || n_nationkey || '"^^<{T.XSD}int>' as key from nation""")
_add("results_ask_xml", lambda spark, d: R.from_results_xml(spark, R.ask_xml(Planner(_star(spark, d)).ask(PREFIX + 'ASK { ?n :n_name "NATION_3" }'))), "select exists (select 1 from nation where n_name = 'NATION_3') as result")


def _over_http(spark: SparkSession, d: str) -> DataFrame:
    """A store served over HTTP and queried as an endpoint: a join with a table here, a group of patterns there."""
    with SparqlServer(_star(spark, d)) as server:
        return endpoint_store(spark, server.url).add_source(mapped(table(spark, d, "supplier"), "supplier", "s_suppkey", {"s_nationkey": ("s_nation", "nation")})).query(PREFIX + "SELECT ?s ?name ?rname { ?s :s_nation ?n . ?n :n_name ?name ; :n_region ?r . ?r :r_name ?rname }")


_add("http_endpoint_join", _over_http, f"""select '<{EX}supplier/' || s_suppkey || '>' as s, '"' || n_name || '"' as name, '"' || r_name || '"' as rname from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")


def _http_limit(spark: SparkSession, d: str) -> DataFrame:
    with SparqlServer(_star(spark, d), max_limit=7) as server:
        return endpoint_store(spark, server.url).query(PREFIX + "SELECT ?n { ?n a :Nation }").agg(F.count(F.lit(1)).alias("n"))


_add("http_max_limit", _http_limit, "select least(7, count(*)) as n from nation")

# the store
_add("store_contains", lambda spark, d: _line(spark, term=_star(spark, d).contains_term('"ASIA"'), no_term=_star(spark, d).contains_term('"MOON"'), statement=_star(spark, d).contains(f"<{EX}nation/3>", f"<{EX}n_region>"), no_statement=_star(spark, d).contains(f"<{EX}nation/3>", f"<{EX}r_name>")), "select exists (select 1 from region where r_name = 'ASIA') as term, exists (select 1 from region where r_name = 'MOON') as no_term, exists (select 1 from nation where n_nationkey = 3) as statement, false as no_statement")
_add("store_graphs_and_default", lambda spark, d: _star(spark, d).add_source(_pages(spark, d)).graphs(with_default=True), f"select distinct '<{EX}source/' || source || '>' as term from documents where source is not null union all select ''")
_add("store_total", lambda spark, d: _line(spark, n=mapped_store(spark, d, ["customer"]).count()), "select cast(7 * count(*) as int) as n from customer")
_add("store_select_limit", lambda spark, d: mapped_store(spark, d, ["customer"]).select(p=f"<{EX}c_name>", limit=17).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects")), "select least(17, count(*)) as n, least(17, count(*)) as subjects from customer")
_add("store_cached", lambda spark, d: _star(spark, d).cached().select(p=f"<{EX}n_name>").select("s", "o"), _STAR + f"select s, o from q where p = '<{EX}n_name>'")
_add("store_explained", lambda spark, d: _star(spark, d).explained().query(PREFIX + "SELECT ?n ?k { ?n :n_regionkey ?k }"), _STAR + f"select s as n, o as k from q where p = '<{EX}n_regionkey>'")
_add("store_cleared", lambda spark, d: _star(spark, d).clear().add((f"<{EX}a>", f"<{EX}b>", '"c"')).select().select(*SPO), f"select '<{EX}a>' as s, '<{EX}b>' as p, '\"c\"' as o")
_add("store_remove_all", lambda spark, d: _star(spark, d).remove_all([(None, f"<{EX}n_region>"), (f"<{EX}nation/3>",), (None, None, f"<{EX}Region>")]).select().select(*SPO), _STAR + f"select * from q where p <> '<{EX}n_region>' and s <> '<{EX}nation/3>' and o <> '<{EX}Region>'")
_add("store_replace_statement", lambda spark, d: _star(spark, d).replace_statement((f"<{EX}region/1>", f"<{EX}r_name>", '"AMERICA"'), (f"<{EX}region/1>", f"<{EX}r_name>", '"AMERICAS"')).select(p=f"<{EX}r_name>").select("s", "o"), _STAR + f"select s, case when s = '<{EX}region/1>' and o = '\"AMERICA\"' then '\"AMERICAS\"' else o end as o from q where p = '<{EX}r_name>'")
_add("store_members_of_a_container", lambda spark, d: rdf_store(spark, d).select(p=T.RDFS_MEMBER).groupBy("p").agg(F.count_distinct("s", "o", "g").alias("n")), "select '<' || e.value || '>' as p, count(distinct (s.subject, s.objecttype, s.object, s.meta)) as n from rdf_statements s join (select id, arg_max(value, added_at) as value from rdf_entities group by id) e on e.id = s.predicate where regexp_matches(e.value, '#_[0-9]+$') and (s.subject in (select id from rdf_entities) or s.subject in (select id from rdf_bnodes)) and (s.objecttype = 0 and (s.object in (select id from rdf_entities) or s.object in (select id from rdf_bnodes)) or s.objecttype = 1 and s.object in (select id from rdf_literals)) group by 1")
_SKOLEM = "with l as (select doc_id, subject_area, annotator from page_labels)"
_add("store_skolem", lambda spark, d: mapped_store(spark, d, ["page_labels"]).skolemize().select(p=f"<{EX}subject_area>").select(F.col("s").startswith("<urn:quadflow:bnode:").alias("named"), "o"), _SKOLEM + """ select distinct true as named, '"' || subject_area || '"' as o from l where false union all select true, '"' || subject_area || '"' from l where subject_area is not null""")
_add("store_unskolem", lambda spark, d: mapped_store(spark, d, ["page_labels"]).skolemize().unskolemize().minus(mapped_store(spark, d, ["page_labels"])).select().agg(F.count(F.lit(1)).alias("n")), "select cast(0 as bigint) as n")
_add("store_meta_query", lambda spark, d: spark.createDataFrame(list(enumerate(_star(spark, d).meta_query([Triple(Var("x"), f"<{EX}{p}>", Var("y")) for p in ("n_name", "r_name", "s_name")]))), "i int, may boolean"), "select unnest([0, 1, 2]) as i, unnest([true, true, false]) as may")


class Upper:
    """A reasoner of one's own: every name also in lower case."""

    def apply(self, quads: DataFrame) -> DataFrame:
        low = quads.where(F.col("p").rlike("_name>$"))
        return quads.unionByName(quads_of(low, F.col("s"), F.lit(f"<{EX}low>"), T.c_literal(F.lower("o_val"))))


_add("store_own_reasoner", lambda spark, d: _star(spark, d).with_reasoner(Upper()).query(PREFIX + "SELECT ?x ?l { ?x :low ?l }"), f"""select '<{EX}nation/' || n_nationkey || '>' as x, '"' || lower(n_name) || '"' as l from nation union all select '<{EX}region/' || r_regionkey || '>', '"' || lower(r_name) || '"' from region""")


def numbers(s: str | None, p: str | None, o: str | None, g: str | None) -> Iterable[tuple]:  # noqa: ARG001
    """A source in Python: i is followed by i + 1, up to 1000."""
    for i in range(1000):
        yield f"<urn:n:{i}>", "<urn:next>", f"<urn:n:{i + 1}>"


_add("own_source", lambda spark, d: QuadStore.of(python_source(spark, f"{__name__}:numbers")).query("SELECT ?a ?c { ?a <urn:next> ?b . ?b <urn:next> ?c }"), "select '<urn:n:' || range || '>' as a, '<urn:n:' || range + 2 || '>' as c from range(999)")


def sink(rows: Iterable[tuple]) -> None:
    """A sink in Python: a file of JSON lines per partition, in the folder that the first statement's graph names."""
    rows = list(rows)
    if rows:
        folder = T.parse_term(rows[0][3]).value[len("urn:folder:") :]
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{uuid.uuid4().hex}.json", "w", encoding="utf-8") as f:
            f.writelines(json.dumps({"s": r[0], "p": r[1], "o": r[2]}) + "\n" for r in rows)


def _sunk(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "sink")
    python_sink(_star(spark, d).quads.withColumn("g", F.lit(f"<urn:folder:{_local(path)}>")), f"{__name__}:sink")
    return spark.read.schema("s string, p string, o string").json(path)


_add("own_sink", _sunk, _STAR + "select * from q")
register_python("urn:quadflow:fn:reversed", lambda x: T.literal(T.parse_term(x).value[::-1]))
_add("own_python_function", lambda spark, d: Planner(_star(spark, d)).natives(PREFIX + 'SELECT ?n { ?n :n_name ?name FILTER(fn:reversed(?name) = "3_NOITAN") }'), "select n_nationkey as n from nation where reverse(n_name) = '3_NOITAN'")
mathrel.register_relation("urn:quadflow:first", lambda x: T.c_literal(F.substring(T.c_text(x), 1, 3)))
_v = Var
_add("own_relation", lambda spark, d: RuleEngine([Rule([Triple(_v("n"), f"<{EX}r_name>", _v("x")), Call("<urn:quadflow:first>", (_v("x"),), _v("y"))], [Triple(_v("n"), "<urn:short>", _v("y"))])]).infer(_star(spark, d).quads).where("p = '<urn:short>'").select("s", "o"), f"""select '<{EX}region/' || r_regionkey || '>' as s, '"' || substr(r_name, 1, 3) || '"' as o from region""")

# filters
_ORDERS = "customer"


def _dsl(name: str, column: str, tests: list, where: str) -> None:
    _add(f"filter_dsl_{name}", lambda spark, d: mapped_store(spark, d, [_ORDERS]).match([Triple(Var("c"), f"<{EX}{column}>", Var("x"))], filters={"x": tests}).select(F.regexp_extract("c", "([0-9]+)>$", 1).cast("bigint").alias("c")), f"select c_custkey as c from customer where {where}")


_dsl("string", "c_mktsegment", [L.StringCompare("<", "FURNITURE")], "c_mktsegment < 'FURNITURE'")
_dsl("string_equal", "c_mktsegment", [L.LiteralFilter.create("=", "BUILDING")], "c_mktsegment = 'BUILDING'")
_dsl("ends_with", "c_mktsegment", [L.StringEndsWith("Y"), L.StringContains("CH")], "c_mktsegment like '%Y' and c_mktsegment like '%CH%'")
_dsl("created_number", "c_acctbal", [L.LiteralFilter.create("<=", 1234.5), L.LiteralFilter.create("!=", 0)], "c_acctbal <= 1234.5 and c_acctbal <> 0")
_add("filter_dsl_created_date", lambda spark, d: mapped_store(spark, d, ["orders"]).match([Triple(Var("o"), f"<{EX}o_orderdate>", Var("t"))], filters={"t": [L.LiteralFilter.create(">=", dt.datetime(1996, 1, 1))]}).select(F.regexp_extract("o", "([0-9]+)>$", 1).cast("bigint").alias("o")), "select o_orderkey as o from orders where o_orderdate >= timestamp '1996-01-01'")


def _durations(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a size of so many hours as a duration, longer than a day and a half."""
    part = table(spark, d, "part")
    hours = F.concat(F.lit("P"), F.floor(F.col("p_size") / 24), F.lit("DT"), F.col("p_size") % 24, F.lit("H"))
    o = F.concat(F.lit('"'), hours, F.lit(f'"^^<{T.XSD}duration>'))
    q = quads_of(part, F.concat(F.lit("<urn:part:"), F.col("p_partkey"), F.lit(">")), F.lit("<urn:takes>"), o)
    return QuadStore.of(q, True).select(filters=[L.DurationCompare(">", dt.timedelta(hours=36))]).select("s")


_add("filter_dsl_duration", _durations, "select '<urn:part:' || p_partkey || '>' as s from part where p_size > 36")
_add("filter_literal_subject", lambda spark, d: Planner(_star(spark, d)).natives(PREFIX + 'SELECT ?n ?x { { ?n :n_name ?x } UNION { "NATION_3" :n_name ?x } }'), "select n_nationkey as n, n_name as x from nation")
_add("filter_exact_numbers", lambda spark, d: QuadStore.of(quads_of(table(spark, d, "part"), F.concat(F.lit("<urn:part:"), F.col("p_partkey"), F.lit(">")), F.lit("<urn:n>"), F.concat(F.lit('"'), (F.lit(2**53) + F.col("p_partkey")).cast("string"), F.lit(f'"^^<{T.XSD}integer>'))), True).query(f"SELECT ?s {{ ?s <urn:n> ?x FILTER(?x = {2**53 + 7} || ?x > {2**53 + 100}) }}"), "select '<urn:part:' || p_partkey || '>' as s from part where p_partkey = 7 or p_partkey > 100")

# forms of queries
_add("select_reduced", lambda spark, d: Planner(mapped_store(spark, d, ["customer"])).natives(PREFIX + "SELECT REDUCED ?m { ?c :c_mktsegment ?m }").select("m").distinct(), "select distinct c_mktsegment as m from customer")
_add("select_max_limit", lambda spark, d: Planner(mapped_store(spark, d, ["customer"]), max_limit=12).natives(PREFIX + "SELECT ?c { ?c a :Customer } ORDER BY ?c LIMIT 100"), "select c_custkey as c from customer order by cast(c_custkey as varchar) limit 12")
_add("describe_back_links", lambda spark, d: (lambda p: p.describe(parse(PREFIX + "DESCRIBE <http://ex.org/nation/7>"), back_links=10))(Planner(mapped_store(spark, d, ["nation", "customer"]))).where(F.col("s") != f"<{EX}nation/7>").select("s", "p", "o"), f"select s, '<{EX}c_nation>' as p, '<{EX}nation/7>' as o from (select '<{EX}customer/' || c_custkey || '>' as s from customer where c_nationkey = 7 order by s limit 10)")


def _from_named(spark: SparkSession, d: str) -> DataFrame:
    text = PREFIX + "SELECT ?p ?t FROM <http://ex.org/source/momobo-courier> FROM NAMED <http://ex.org/source/kimede-post> { { ?p :text ?t } UNION { GRAPH ?g { ?p :text ?t } } }"
    store = QuadStore(spark).add_source(_pages(spark, d))
    return Planner(store, dataset="w3c").run(text).select("p", F.length("t").alias("n"))


_add("select_from_named", _from_named, _PAGES + f"select s as p, length(o) as n from q where g in ('<{EX}source/momobo-courier>', '<{EX}source/kimede-post>')")
_add("query_prefixes_kept", lambda spark, d: spark.createDataFrame(sorted(parse(PREFIX + "SELECT ?x { ?x a :Nation }").prefixes.items()), "prefix string, iri string").where("prefix in ('', 'xsd')"), f"select '' as prefix, '{EX}' as iri union all select 'xsd', '{T.XSD}'")
_add("query_explained", lambda spark, d: _line(spark, steps=sum(x.startswith(("scan", "join")) for x in Planner(mapped_store(spark, d, ["nation", "region"])).explain(PREFIX + 'SELECT ?n { ?n :n_region ?r . ?r :r_name "ASIA" }').splitlines())), "select 2 as steps")
_add("navigate_up_and_down", lambda spark, d: navigate(mapped_store(spark, d, ["nation", "region", "supplier"]), spark.createDataFrame([(f"<{EX}nation/{i}>",) for i in range(25)], "t string"), ":n_region/!:n_region/!:s_nation", {"": EX}), f"select distinct '<{EX}nation/' || a.n_nationkey || '>' as start, '<{EX}supplier/' || s_suppkey || '>' as node from nation a join nation b using (n_regionkey) join supplier on s_nationkey = b.n_nationkey where a.n_nationkey < 25")
_add("navigate_numbered", lambda spark, d: navigate(_star(spark, d), spark.createDataFrame([(f"<{EX}region/{i}>",) for i in range(5)], "t string"), "!:n_region[2]/:n_name", {"": EX}), f"""select '<{EX}region/' || n_regionkey || '>' as start, '"' || n_name || '"' as node from (select *, row_number() over (partition by n_regionkey order by '<{EX}nation/' || n_nationkey || '>') as r from nation) where r = 2 and n_regionkey < 5""")
_add("names_shortened", lambda spark, d: spark.createDataFrame([(x, Namespaces({"x": EX, "rdf": T.RDF}).normalize(x)) for x in (r["term"][1:-1] for r in _star(spark, d).predicates().collect())], "iri string, short string"), _STAR + f"select distinct substr(p, 2, length(p) - 2) as iri, case when starts_with(p, '<{EX}') then 'x:' || substr(p, {len(EX) + 2}, length(p) - {len(EX) + 2}) else 'rdf:type' end as short from q")
_add("iris_valid", lambda spark, d: table(spark, d, "rdf_entities").select("value").distinct().groupBy(T.c_valid_iri(F.col("value")).alias("valid")).agg(F.count(F.lit(1)).alias("n")), r"""select regexp_full_match(value, '[A-Za-z][A-Za-z0-9+.-]*:[^\x00-\x20<>"{}|\\^`]*') and not regexp_matches(value, '%([^0-9A-Fa-f]|$|[0-9A-Fa-f]([^0-9A-Fa-f]|$))') and not regexp_matches(value, '#.*#') as valid, count(distinct value) as n from rdf_entities group by 1""")
_add("literal_numbers", lambda spark, d: mapped_store(spark, d, ["part"]).select(p=[f"<{EX}p_size>", f"<{EX}p_retailprice>", f"<{EX}p_name>"]).groupBy("p").agg(F.count(T.c_double(F.col("o_val"))).alias("numbers"), F.round(F.sum(T.c_double(F.col("o_val"))), 2).alias("total")), f"select '<{EX}p_size>' as p, count(*) as numbers, round(cast(sum(p_size) as double), 2) as total from part union all select '<{EX}p_retailprice>', count(*), round(sum(p_retailprice), 2) from part union all select '<{EX}p_name>', 0, null")

# graphs
_add("graph_find_msg", lambda spark, d: (lambda q: find_msg(q, q.where("startswith(s, '_:')").agg(F.min("s")).first()[0]))(mapped_store(spark, d, ["page_labels"]).quads).select("p").distinct(), f"select unnest(['{TYPE}', '<{EX}doc_id>', '<{EX}subject_area>', '<{EX}annotator>', '<{EX}page>']) as p")


def _connected(spark: SparkSession, d: str) -> DataFrame:
    rows = [tuple(r) for r in _star(spark, d).select(p=f"<{EX}n_region>").select(*SPOG).collect()]  # the nations, a fixed few
    nodes, matrix = connectivity(rows)
    return spark.createDataFrame([(n, sum(m)) for n, m in zip(nodes, matrix, strict=True)], "node string, degree int")


_add("graph_connectivity", _connected, f"select '<{EX}nation/' || n_nationkey || '>' as node, 1 as degree from nation union all select '<{EX}region/' || n_regionkey || '>', cast(count(*) as int) from nation group by 1")

# reasoning
_add("rdfs_select_closure", lambda spark, d: RDFS(rdf_store(spark, d).select(p=SUB_CLASS)).select_closure(SUB_CLASS, b="<http://vocab.mirelle.example/terms#Structure>").select("a"), "with recursive named as (select id, '<' || arg_max(value, added_at) || '>' as term from rdf_entities group by id), node as (select * from named union all select distinct id, '_:b' || id from rdf_bnodes), e as (select distinct s.term as a, o.term as b from rdf_statements st join node s on s.id = st.subject join node o on o.id = st.object where st.objecttype = 0 and st.predicate in (select id from named where term like '%#subClassOf>')), sub as (select a from e where b = '<http://vocab.mirelle.example/terms#Structure>' union select e.a from e join sub on e.b = sub.a) select a from sub")
_HOP = [Rule([Triple(_v("s"), f"<{EX}s_nation>", _v("n")), Triple(_v("n"), f"<{EX}n_region>", _v("r"))], [Triple(_v("s"), "<urn:in>", _v("r"))], "hop")]
_add("rules_as_reasoner", lambda spark, d: mapped_store(spark, d, ["nation", "supplier"]).with_reasoner(RuleEngine(_HOP)).query("SELECT ?s ?r { ?s <urn:in> ?r }"), f"select '<{EX}supplier/' || s_suppkey || '>' as s, '<{EX}region/' || n_regionkey || '>' as r from supplier join nation on s_nationkey = n_nationkey")
_add("rules_prove", lambda spark, d: RuleEngine(_HOP).prove(mapped_store(spark, d, ["nation", "supplier"]).quads, Triple(_v("s"), "<urn:in>", f"<{EX}region/2>")).select("depth", "s", "p", "o").distinct(), f"with x as (select s_suppkey, s_nationkey from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 2) select 0 as depth, '<{EX}supplier/' || s_suppkey || '>' as s, '<urn:in>' as p, '<{EX}region/2>' as o from x union all select 1, '<{EX}supplier/' || s_suppkey || '>', '<{EX}s_nation>', '<{EX}nation/' || s_nationkey || '>' from x union all select distinct 1, '<{EX}nation/' || s_nationkey || '>', '<{EX}n_region>', '<{EX}region/2>' from x")
_SHARED = [Rule([Triple(_v("a"), f"<{EX}n_region>", _v("r")), Triple(_v("b"), f"<{EX}n_region>", _v("r"))], [Triple(_v("r"), "<urn:has>", '"nations"')], "pair")]
_add("rules_all_proofs", lambda spark, d: RuleEngine(_SHARED).prove(_star(spark, d).quads, Triple(_v("r"), "<urn:has>", _v("x")), all_proofs=True).where("depth = 0").groupBy("s").agg(F.count(F.lit(1)).alias("ways")), f"select '<{EX}region/' || n_regionkey || '>' as s, count(*) * count(*) as ways from nation group by 1")
for _name, _relation, _args, _value in [
    ("absolute", "absoluteValue", ("x",), "abs(p_size)"), ("cos", "cos", ("x",), "cos(p_size)"), ("sin", "sin", ("x",), "sin(p_size)"), ("tan", "tan", ("x",), "tan(p_size)"), ("tanh", "tanh", ("x",), "(exp(2 * p_size) - 1) / (exp(2 * p_size) + 1)"),
    ("degrees", "degrees", ("x",), "radians(p_size)"), ("equal", "equalTo", ("y",), "p_retailprice"), ("atan2", "atan2", ("x", "y"), "atan2(p_size, p_retailprice)"), ("quotient", "quotient", ("y", "x"), "p_retailprice / p_size"),
]:
    _add(f"rule_math_{_name}", (lambda f: lambda spark, d: f(spark, d).withColumn("z", F.round("z", 6)))(_rule_math(_relation, _args)), f"select '<{EX}part/' || p_partkey || '>' as s, round(cast({_value} as double), 6) as z from part")
_add("rule_math_power", lambda spark, d: _rule_math("exponentiation", ("x", "x"))(spark, d).select("s", F.format_string("%.9e", "z").alias("z")), f"select '<{EX}part/' || p_partkey || '>' as s, printf('%.9e', pow(p_size, p_size)) as z from part where p_size <= 25 union all select '<{EX}part/' || p_partkey || '>', printf('%.9e', pow(cast(p_size as double), p_size)) from part where p_size > 25")
_add("rule_math_sinh", lambda spark, d: _rule_math("sinh", ("x",))(spark, d).select("s", F.format_string("%.9e", "z").alias("z")), f"select '<{EX}part/' || p_partkey || '>' as s, printf('%.9e', (exp(p_size) - exp(-p_size)) / 2) as z from part")
for _name, _op in (("greaterThan", ">"), ("lessThan", "<"), ("notGreaterThan", "<="), ("notLessThan", ">="), ("notEqualTo", "<>")):
    _add(f"rule_test_{_name}", (lambda n: lambda spark, d: RuleEngine([Rule([Triple(_v("p"), f"<{EX}p_size>", _v("x")), Call(n, (_v("x"),), '"25.0"')], [Triple(_v("p"), "<urn:out>", _v("x"))])]).infer(mapped_store(spark, d, ["part"]).quads).where("p = '<urn:out>'").select("s"))(_name), f"select '<{EX}part/' || p_partkey || '>' as s from part where p_size {_op} 25")
_add("rule_math_exact", lambda spark, d: RuleEngine([Rule([Triple(_v("p"), f"<{EX}p_partkey>", _v("x")), Call("sum", (_v("x"), f'"{2**53 + 1}"'), _v("z"))], [Triple(_v("p"), "<urn:out>", _v("z"))])]).infer(mapped_store(spark, d, ["part"]).quads).where("p = '<urn:out>'").select("s", "o"), f"""select '<{EX}part/' || p_partkey || '>' as s, '"' || p_partkey + {2**53 + 1} || '"^^<{T.XSD}integer>' as o from part""")
_add("rule_math_bound", lambda spark, d: RuleEngine([Rule([Triple(_v("p"), f"<{EX}p_size>", _v("x")), Call("product", (_v("x"), '"1000000000000"'), f'"{7 * 10**12}"')], [Triple(_v("p"), "<urn:out>", _v("x"))]), Rule([Triple(_v("p"), f"<{EX}p_size>", _v("x")), Call("product", (_v("x"), '"1000000000000"'), f'"{9 * 10**12 + 1}"')], [Triple(_v("p"), "<urn:out>", _v("x"))])]).infer(mapped_store(spark, d, ["part"]).quads).where("p = '<urn:out>'").select("s"), f"select '<{EX}part/' || p_partkey || '>' as s from part where p_size = 7")


# tools
def _tool(spark: SparkSession, *args: str) -> DataFrame:
    from quadflow.cli import main

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        main(list(args), spark)
    return spark.createDataFrame([(x,) for x in out.getvalue().splitlines()], "line string")


def _tool_convert(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "tool")
    _tool(spark, "convert", f"tables:{d}", f"nt:{path}", "--graph", "urn:all")
    return open_store(spark, f"nt:{path}").select(p=f"<{EX}n_name>").select(*SPOG)


def _tool_prove(spark: SparkSession, d: str) -> DataFrame:
    path = _local(scratch(spark, "rules")) + ".n3"
    facts = "\n".join(f"<urn:n{r['n_nationkey']}> <urn:in> <urn:r{r['n_regionkey']}> ." for r in table(spark, d, "nation").collect())  # the nations, a fixed few
    with open(path, "w", encoding="utf-8") as f:
        f.write(facts + "\n{ ?n <urn:in> ?r } => { ?r <urn:holds> ?n } .\n")
    return _tool(spark, "prove", path, "<urn:r2> <urn:holds> ?n .").where("line like '<urn:r%'").select(F.regexp_replace("line", r"\..*$", ".").alias("line"))


_add("tool_query", lambda spark, d: _tool(spark, "query", f"tables:{d}", PREFIX + "SELECT ?n ?name { ?n :n_name ?name }", "--format", "csv"), f"select 'n,name' as line union all select '{EX}nation/' || n_nationkey || ',' || n_name from nation")
_add("tool_convert", _tool_convert, f"""select '<{EX}nation/' || n_nationkey || '>' as s, '<{EX}n_name>' as p, '"' || n_name || '"' as o, '<urn:all>' as g from nation""")
_add("tool_prove", _tool_prove, "select '<urn:r2> <urn:holds> <urn:n' || n_nationkey || '>.' as line from nation where n_regionkey = 2")
