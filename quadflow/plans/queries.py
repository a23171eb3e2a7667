"""Queries over the tables mapped to statements and over the dictionary-encoded store, and SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadflow.functions import terms as T
from quadflow.operators.filters import DateTimeCompare, NumericCompare, StringContains, StringStartsWith
from quadflow.operators.graph import make_lean, msgs
from quadflow.operators.hierarchy import link_edges
from quadflow.operators.store import QuadStore, quads_from, quads_of
from quadflow.plans.algebra import Triple, Var
from quadflow.plans.planner import Builder, Planner
from quadflow.reason.rdfs import RDFS, WidenedStore
from quadflow.reason.rules import Rule, RuleEngine
from quadflow.sources.mapping import EX, mapped, mapped_store, rdf_store
from quadflow.runtime import table

PREFIX = f"PREFIX : <{EX}> PREFIX t: <http://vocab.mirelle.example/terms#> PREFIX rdf: <{T.RDF}> PREFIX rdfs: <{T.RDFS}> PREFIX xsd: <{T.XSD}> PREFIX fn: <urn:quadflow:fn:>\n"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _sparql(name: str, tables: str, text: str, sql: str, casts: dict[str, str] | None = None) -> None:
    """A SELECT over mapped tables, its solutions as native values."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = Planner(mapped_store(spark, d, tables.split())).natives(PREFIX + text)
        return df.withColumns({c: F.col(c).cast(t) for c, t in casts.items()}) if casts else df

    _add(name, run, sql)


def _store(name: str, text: str, sql: str) -> None:
    """A SELECT over the dictionary-encoded store, its solutions as terms."""
    _add(name, lambda spark, d: rdf_store(spark, d).query(PREFIX + text), _TERMS + sql)


# basic graph patterns
_sparql("bgp_nation_region", "nation region", 'SELECT ?n ?name { ?n a :Nation ; :n_name ?name ; :n_region ?r . ?r :r_name "ASIA" }', "select n_nationkey as n, n_name as name from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'")
_sparql("bgp_three_hop", "customer nation region", "SELECT ?c ?cname ?nname ?rname { ?c :c_name ?cname ; :c_nation ?n . ?n :n_name ?nname ; :n_region ?r . ?r :r_name ?rname }", "select c_custkey as c, c_name as cname, n_name as nname, r_name as rname from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
_sparql("bgp_star_part", "part", "SELECT ?p ?name ?brand ?type ?size ?price { ?p a :Part ; :p_name ?name ; :p_brand ?brand ; :p_type ?type ; :p_size ?size ; :p_retailprice ?price }", "select p_partkey as p, p_name as name, p_brand as brand, p_type as type, p_size as size, p_retailprice as price from part")
_sparql("bgp_orders_lineitem", "orders lineitem customer nation", 'SELECT ?o ?q ?d ?nname { ?l :l_order ?o ; :l_quantity ?q ; :l_shipdate ?d . ?o :o_customer ?c ; :o_orderpriority "1-URGENT" . ?c :c_nation ?n . ?n :n_name ?nname }', "select o_orderkey as o, l_quantity as q, l_shipdate as d, n_name as nname from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderpriority = '1-URGENT'")
_sparql("bgp_repeated_value", "customer supplier", "SELECT ?c ?s { ?c :c_nationkey ?k . ?s :s_nationkey ?k }", "select c_custkey as c, s_suppkey as s from customer join supplier on c_nationkey = s_nationkey")
_sparql("bgp_cartesian", "region", "SELECT ?a ?b { ?x a :Region ; :r_name ?a . ?y a :Region ; :r_name ?b }", "select a.r_name as a, b.r_name as b from region a, region b")
_sparql("bgp_ground_test", "nation region", 'SELECT ?n { ?n a :Nation . <http://ex.org/region/2> :r_name "ASIA" }', "select n_nationkey as n from nation where exists (select 1 from region where r_regionkey = 2 and r_name = 'ASIA')")
_sparql("bgp_var_predicate", "region", "SELECT ?p ?o { <http://ex.org/region/1> ?p ?o }", "select 'http://ex.org/r_regionkey' as p, '1' as o union all select 'http://ex.org/r_name', r_name from region where r_regionkey = 1 union all select 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://ex.org/Region'")
_add("known_values", lambda spark, d: mapped_store(spark, d, ["nation"]).match([Triple(Var("n"), f"<{EX}n_name>", Var("name"))], known={"name": [T.literal(f"NATION_{k}") for k in (1, 5, 9, 99)]}).select(F.regexp_extract("n", "([0-9]+)>$", 1).cast("int").alias("n"), T.c_text(F.col("name")).alias("name")), "select n_nationkey as n, n_name as name from nation where n_name in ('NATION_1', 'NATION_5', 'NATION_9', 'NATION_99')")

# filters
for _name, _test, _where in [
    ("numeric_lt", "?s < 10", "p_size < 10"),
    ("numeric_ge", "?s >= 40.0", "p_size >= 40"),
    ("numeric_ne", "?s != 7", "p_size <> 7"),
    ("const_left", "5 <= ?s && 2 * ?s + 1 < 31", "5 <= p_size and 2 * p_size + 1 < 31"),
    ("double", "?price > 9.5e2", "p_retailprice > 950"),
    ("string_eq", '?t = "PROMO"', "p_type = 'PROMO'"),
    ("string_lt", '?t < "MEDIUM"', "p_type < 'MEDIUM'"),
    ("string_starts", 'regex(?t, "^S")', "p_type like 'S%'"),
    ("string_contains", 'regex(?name, "ring")', "p_name like '%ring%'"),
    ("string_ends", 'regex(?name, "widget$")', "p_name like '%widget'"),
    ("regex_plain", 'regex(?name, "^r.d .*[gt]$")', "regexp_matches(p_name, '^r.d .*[gt]$')"),
    ("regex_ci", 'regex(?t, "^promo$", "i")', "upper(p_type) = 'PROMO'"),
    ("or_error", '?t < 5 || ?s = 3', "p_size = 3"),
    ("not_error", '!(?t < 5) || ?s = 4', "p_size = 4"),
    ("cast", 'xsd:integer(str(?s)) = 12 || xsd:double(?price) < 901', "p_size = 12 or p_retailprice < 901"),
    ("builtins", 'isIRI(?p) && isLITERAL(?s) && !isBLANK(?p) && datatype(?s) = xsd:int && lang(?t) = "" && sameTerm(?t, "SMALL")', "p_type = 'SMALL'"),
    ("arithmetic", "?price / 2 - ?s * 3 > 400", "p_retailprice / 2 - p_size * 3 > 400"),
]:
    _sparql(f"filter_{_name}", "part", f"SELECT ?p ?s {{ ?p :p_size ?s ; :p_type ?t ; :p_name ?name ; :p_retailprice ?price FILTER({_test}) }}", f"select p_partkey as p, p_size as s from part where {_where}")
_sparql("filter_datetime_range", "orders", 'SELECT ?o ?d { ?o :o_orderdate ?d FILTER(?d >= "1997-01-01T00:00:00"^^xsd:dateTime && ?d < "1997-04-01T00:00:00"^^xsd:dateTime) }', "select o_orderkey as o, o_orderdate as d from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1997-04-01'")
_add("filter_dsl", lambda spark, d: mapped_store(spark, d, ["customer"]).match([Triple(Var("c"), f"<{EX}c_acctbal>", Var("b")), Triple(Var("c"), f"<{EX}c_mktsegment>", Var("m"))], filters={"b": [NumericCompare(">", 5000)], "m": [StringStartsWith("B"), StringContains("ILD")]}).select(F.regexp_extract("c", "([0-9]+)>$", 1).cast("bigint").alias("c")), "select c_custkey as c from customer where c_acctbal > 5000 and c_mktsegment like 'B%' and c_mktsegment like '%ILD%'")
_add("filter_dsl_datetime", lambda spark, d: mapped_store(spark, d, ["events"]).match([Triple(Var("e"), f"<{EX}ts>", Var("t"))], filters={"t": [DateTimeCompare("<", dt.datetime(2024, 1, 2))]}).select(F.regexp_extract("e", "([0-9]+)>$", 1).cast("bigint").alias("e")), "select event_id as e from events where ts < timestamp '2024-01-02'")

# optional parts, unions, modifiers
_sparql("optional_labels", "documents page_labels", "SELECT ?d ?a { ?d a :Documents OPTIONAL { ?l :page ?d ; :subject_area ?a } }", "select d.doc_id as d, subject_area as a from documents d left join page_labels l on l.doc_id = d.doc_id")
_sparql("optional_filter_in_on", "documents page_labels", 'SELECT ?d ?a { ?d a :Documents OPTIONAL { ?l :page ?d ; :subject_area ?a FILTER(?a = "law") } }', "select d.doc_id as d, subject_area as a from documents d left join page_labels l on l.doc_id = d.doc_id and subject_area = 'law'")
_sparql("optional_filter_across", "customer supplier", "SELECT ?c ?s { ?c :c_nation ?n ; :c_acctbal ?b OPTIONAL { ?s :s_nation ?n ; :s_acctbal ?x FILTER(?x > ?b) } }", "select c_custkey as c, s_suppkey as s from customer left join supplier on c_nationkey = s_nationkey and s_acctbal > c_acctbal")
_sparql("optional_not_bound", "documents page_labels", "SELECT ?d { ?d a :Documents OPTIONAL { ?l :page ?d } FILTER(!bound(?l)) }", "select doc_id as d from documents where doc_id not in (select doc_id from page_labels)")
_sparql("optional_chain", "documents page_labels", "SELECT ?d ?a ?src { ?d a :Documents OPTIONAL { ?l :page ?d ; :subject_area ?a } OPTIONAL { ?d :lang ?src FILTER(?src = \"en\") } }", "select d.doc_id as d, subject_area as a, case when lang = 'en' then lang end as src from documents d left join page_labels l on l.doc_id = d.doc_id")
_sparql("optional_shared", "nation supplier customer", 'SELECT ?n ?x { ?n a :Nation OPTIONAL { ?x :s_nation ?n ; :s_acctbal ?b FILTER(?b > 9000) } OPTIONAL { ?x :c_nation ?n ; :c_acctbal ?b2 FILTER(?b2 > 9900) } }', "with a as (select n_nationkey as n, 'http://ex.org/supplier/' || s_suppkey as x from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 9000) select n, x from a where x is not null union all select n, case when c_custkey is not null then 'http://ex.org/customer/' || c_custkey end from a left join customer on c_nationkey = n and c_acctbal > 9900 where x is null")
_sparql("union_customer_supplier", "customer supplier", "SELECT ?x ?name { { ?x :c_name ?name } UNION { ?x :s_name ?name } }", "select 'http://ex.org/customer/' || c_custkey as x, c_name as name from customer union all select 'http://ex.org/supplier/' || s_suppkey, s_name from supplier")
_sparql("union_unbound", "customer supplier", "SELECT ?c ?s ?n { { ?c :c_nation ?n } UNION { ?s :s_nation ?n } }", "select c_custkey as c, null::bigint as s, c_nationkey as n from customer union all select null, s_suppkey, s_nationkey from supplier")
_sparql("distinct_segment", "customer", "SELECT DISTINCT ?m { ?c :c_mktsegment ?m }", "select distinct c_mktsegment as m from customer")
_sparql("order_limit_offset", "orders", "SELECT ?o ?t { ?o :o_totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 20 OFFSET 5", "select o_orderkey as o, o_totalprice as t from orders order by t desc, o limit 20 offset 5")
_sparql("order_terms", "customer supplier", "SELECT ?x { { ?x :c_nation <http://ex.org/nation/3> } UNION { ?x :s_nation <http://ex.org/nation/3> } } ORDER BY ?x LIMIT 10", "select x from (select 'http://ex.org/customer/' || c_custkey as x from customer where c_nationkey = 3 union all select 'http://ex.org/supplier/' || s_suppkey from supplier where s_nationkey = 3) order by x limit 10")
_sparql("limit_zero", "nation", "SELECT ?n { ?n a :Nation } LIMIT 0", "select n_nationkey as n from nation limit 0")


def _by_source(spark: SparkSession, d: str) -> QuadStore:
    return QuadStore(spark).add_source(mapped(table(spark, d, "documents"), "documents", "doc_id", graph="source"))


_add("graph_named", lambda spark, d: Planner(_by_source(spark, d)).natives(PREFIX + "SELECT ?d ?l { GRAPH <http://ex.org/source/momobo-courier> { ?d :lang ?l } }"), "select doc_id as d, lang as l from documents where source = 'momobo-courier' and lang is not null")
_add("graph_var", lambda spark, d: Planner(_by_source(spark, d)).natives(PREFIX + "SELECT ?g ?d { GRAPH ?g { ?d :lang ?l ; :n_chars ?n FILTER(?n > 3000) } }"), "select source as g, doc_id as d from documents where lang is not null and n_chars > 3000")
_add("ask_true", lambda spark, d: mapped_store(spark, d, ["nation"]).query(PREFIX + 'ASK { ?n :n_name "NATION_3" }'), "select exists (select 1 from nation where n_name = 'NATION_3') as result")
_add("ask_false", lambda spark, d: mapped_store(spark, d, ["nation"]).query(PREFIX + 'ASK { ?n :n_name "ATLANTIS" }'), "select exists (select 1 from nation where n_name = 'ATLANTIS') as result")
_add("construct_names", lambda spark, d: mapped_store(spark, d, ["nation"]).query(PREFIX + "CONSTRUCT { ?n rdfs:label ?name . ?name :bad ?n . ?n :in ?r } { ?n :n_name ?name ; :n_region ?r }").select("s", "p", "o"), """select '<http://ex.org/nation/' || n_nationkey || '>' as s, '<http://www.w3.org/2000/01/rdf-schema#label>' as p, '"' || n_name || '"' as o from nation union all select '<http://ex.org/nation/' || n_nationkey || '>', '<http://ex.org/in>', '<http://ex.org/region/' || n_regionkey || '>' from nation""")
_add("describe_nation", lambda spark, d: mapped_store(spark, d, ["nation", "region"]).query(PREFIX + "DESCRIBE <http://ex.org/region/1>").select("s", "p", "o"), """with b as (select n_nationkey, n_name from nation where n_regionkey = 1) select '<http://ex.org/region/1>' as s, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' as p, '<http://ex.org/Region>' as o union all select '<http://ex.org/region/1>', '<http://ex.org/r_regionkey>', '"1"^^<http://www.w3.org/2001/XMLSchema#int>' union all select '<http://ex.org/region/1>', '<http://ex.org/r_name>', '"' || r_name || '"' from region where r_regionkey = 1 union all select '<http://ex.org/nation/' || n_nationkey || '>', '<http://ex.org/n_region>', '<http://ex.org/region/1>' from b""")

# the store's own operations
_add("store_predicates", lambda spark, d: mapped_store(spark, d, ["nation", "region"]).predicates(), "select unnest(['<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<http://ex.org/n_nationkey>', '<http://ex.org/n_name>', '<http://ex.org/n_regionkey>', '<http://ex.org/n_region>', '<http://ex.org/r_regionkey>', '<http://ex.org/r_name>']) as term")
_add("store_count", lambda spark, d: mapped_store(spark, d, ["nation", "customer"]).quads.groupBy("p").agg(F.count(F.lit(1)).alias("n")), "select '<http://ex.org/' || k || '>' as p, n from (select unnest(['n_nationkey', 'n_name', 'n_regionkey', 'n_region']) as k, (select count(*) from nation) as n union all select unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_nation', 'c_acctbal', 'c_mktsegment']), (select count(*) from customer)) union all select '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', (select count(*) from nation) + (select count(*) from customer)")
_add("store_entities_of_type", lambda spark, d: mapped_store(spark, d, ["nation", "region"]).entities_of_type(f"<{EX}Region>"), "select '<http://ex.org/region/' || r_regionkey || '>' as s from region")
_add("store_select_objects", lambda spark, d: mapped_store(spark, d, ["nation"]).select_objects(f"<{EX}nation/7>", f"<{EX}n_name>"), """select '"' || n_name || '"' as o from nation where n_nationkey = 7""")
_add("store_entities", lambda spark, d: mapped_store(spark, d, ["region"]).entities(), "select '<http://ex.org/region/' || r_regionkey || '>' as term from region union select unnest(['<http://ex.org/Region>', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<http://ex.org/r_regionkey>', '<http://ex.org/r_name>'])")
_add("store_difference", lambda spark, d: mapped_store(spark, d, ["nation"]).minus(mapped_store(spark, d, ["nation"]).remove(p=f"<{EX}n_name>")).quads.select("s", "o"), """select '<http://ex.org/nation/' || n_nationkey || '>' as s, '"' || n_name || '"' as o from nation""")
_add("store_replace_entity", lambda spark, d: mapped_store(spark, d, ["nation"]).replace_entity(f"<{EX}region/1>", "<urn:new>").select(p=f"<{EX}n_region>").select("s", "o"), "select '<http://ex.org/nation/' || n_nationkey || '>' as s, case when n_regionkey = 1 then '<urn:new>' else '<http://ex.org/region/' || n_regionkey || '>' end as o from nation")
_add("store_remove_template", lambda spark, d: mapped_store(spark, d, ["nation"]).remove(p=f"<{EX}n_region>", o=f"<{EX}region/1>").select(p=f"<{EX}n_region>").select("s", "o"), "select '<http://ex.org/nation/' || n_nationkey || '>' as s, '<http://ex.org/region/' || n_regionkey || '>' as o from nation where n_regionkey <> 1")
_add("store_select_filter", lambda spark, d: mapped_store(spark, d, ["nation", "customer"]).select(p=[f"<{EX}c_acctbal>", f"<{EX}c_custkey>"], filters=[NumericCompare(">=", 9000)]).select("s", "p", "o_val"), "select '<http://ex.org/customer/' || c_custkey || '>' as s, '<http://ex.org/c_acctbal>' as p, cast(c_acctbal as varchar) as o_val from customer where c_acctbal >= 9000 union all select '<http://ex.org/customer/' || c_custkey || '>', '<http://ex.org/c_custkey>', cast(c_custkey as varchar) from customer where c_custkey >= 9000")
_add("store_import", lambda spark, d: mapped_store(spark, d, ["region"]).import_quads(quads_from(spark, [(f"<{EX}region/9>", f"<{EX}r_name>", '"MOON"'), (f"<{EX}region/1>", T.RDF_TYPE, f"<{EX}Region>")])).quads.groupBy("p").agg(F.count(F.lit(1)).alias("n")), "select '<http://ex.org/r_name>' as p, count(*) + 1 as n from region union all select '<http://ex.org/r_regionkey>', count(*) from region union all select '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', count(*) from region")
_add("slice_one_based", lambda spark, d: _sliced(spark, d), "select n from (select n_nationkey as n from nation order by n limit 10 offset 3) order by n limit 7")


def _sliced(spark: SparkSession, d: str) -> DataFrame:
    from quadflow.plans.planner import slice_from

    df = Planner(mapped_store(spark, d, ["nation"])).natives(PREFIX + "SELECT ?n { ?n a :Nation } ORDER BY ?n")
    return slice_from(df.orderBy("n"), 4, 10)


def _query_graph(spark: SparkSession, d: str) -> DataFrame:
    graph = [("?n", T.RDF_TYPE, f"<{EX}Nation>"), ("?n", f"<{EX}n_region>", "_:r"), ("_:r", f"<{EX}r_name>", '"EUROPE"'), ("<urn:q>", "<urn:quadflow:query#returnLimit>", '"100"')]
    return Builder.of_graph(graph).run(mapped_store(spark, d, ["nation", "region"]))


_add("query_graph", _query_graph, "select '<http://ex.org/nation/' || n_nationkey || '>' as n from nation join region on n_regionkey = r_regionkey where r_name = 'EUROPE'")

def _query_graph_limit(spark: SparkSession, d: str) -> DataFrame:
    """Rows 3 to 20 of the customers of a nation, counted, by the words of a query graph."""
    graph = [("?c", f"<{EX}c_nation>", "_:n"), ("_:n", f"<{EX}n_name>", '"NATION_7"'), ("<urn:q>", "<urn:quadflow:query#returnLimit>", '"20"'), ("<urn:q>", "<urn:quadflow:query#returnStart>", '"3"')]
    return Builder.of_graph(graph).run(mapped_store(spark, d, ["nation", "customer"])).agg(F.count(F.lit(1)).alias("n"))


_add("query_graph_limit", _query_graph_limit, "select greatest(least(count(*), 20) - 2, 0) as n from customer join nation on c_nationkey = n_nationkey where n_name = 'NATION_7'")

# the dictionary-encoded store
_TERMS = """with named as (select id, '<' || arg_max(value, added_at) || '>' as term from rdf_entities group by id),
node as (select * from named union all select distinct id, '_:b' || id from rdf_bnodes),
lit as (select id, arg_max({'v': value, 'l': language, 'd': datatype}, added_at) as x from rdf_literals group by id),
text as (select id, '"' || replace(replace(replace(replace(replace(x.v, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"' ||
  case when x.l is not null then '@' || x.l when x.d is not null then '^^<' || x.d || '>' else '' end as term, x.v as v, x.l as l, x.d as d from lit),
quad as (select distinct s.term as s, p.term as p, coalesce(o.term, t.term) as o, t.v as o_val, t.l as o_lang, t.d as o_dt,
  case when meta = 1 then '' else coalesce(g.term, '<urn:quadflow:graph:' || meta || '>') end as g from rdf_statements st
  join node s on s.id = st.subject join named p on p.id = st.predicate left join node o on st.objecttype = 0 and o.id = st.object left join text t on st.objecttype = 1 and t.id = st.object
  left join node g on g.id = st.meta where coalesce(o.term, t.term) is not null)
"""
_V = "<http://vocab.mirelle.example/terms#"
_store("rdf_two_hop", "SELECT ?a ?b ?c { GRAPH ?g { ?a t:partOf ?b } GRAPH ?h { ?b t:partOf ?c } }", f"select a.s as a, b.s as b, b.o as c from quad a join quad b on a.o = b.s where a.p = '{_V}partOf>' and b.p = a.p and a.g <> '' and b.g <> ''")
_store("rdf_labels", 'SELECT ?x ?l { ?x a t:Bridge ; rdfs:label ?l FILTER(langMatches(lang(?l), "en")) }', f"select a.s as x, b.o as l from quad a join quad b on a.s = b.s and b.g = '' where a.g = '' and a.p like '%#type>' and a.o = '{_V}Bridge>' and b.p like '%rdf-schema#label>' and (lower(b.o_lang) = 'en' or lower(b.o_lang) like 'en-%')")
_store("rdf_same_node", "SELECT ?x ?p ?g { GRAPH ?g { ?x ?p ?x } }", "select s as x, p, g from quad where s = o and g <> ''")
_store("rdf_typed_filter", "SELECT ?x ?n { ?x t:population ?n FILTER(?n > 100000) }", f"select s as x, o as n from quad where g = '' and p = '{_V}population>' and o_dt in (select 'http://www.w3.org/2001/XMLSchema#' || unnest(['integer', 'nonPositiveInteger', 'negativeInteger', 'nonNegativeInteger', 'positiveInteger', 'long', 'int', 'short', 'byte', 'unsignedLong', 'unsignedInt', 'unsignedShort', 'unsignedByte', 'decimal', 'float', 'double'])) and regexp_full_match(o_val, '[ \t\r\n]*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?[ \t\r\n]*') and try_cast(trim(o_val, ' ' || chr(9) || chr(10) || chr(13)) as double) > 100000")
_store("rdf_optional", "SELECT ?x ?y ?h { GRAPH <http://data.mirelle.example/graph/godiba-poda> { ?x t:related ?y OPTIONAL { ?x t:heightCm ?h } } }", f"select a.s as x, a.o as y, b.o as h from quad a left join quad b on b.s = a.s and b.g = a.g and b.p = '{_V}heightCm>' where a.p = '{_V}related>' and a.g = '<http://data.mirelle.example/graph/godiba-poda>'")
_add("rdf_graphs", lambda spark, d: rdf_store(spark, d).graphs(), _TERMS + "select distinct g as term from quad where g <> ''")
_add("rdf_members", lambda spark, d: rdf_store(spark, d).select(p=T.RDFS_MEMBER).select("s", "p", "o", "g"), _TERMS + "select s, p, o, g from quad where regexp_matches(p, '#_[0-9]+>$')")


def _member_order(spark: SparkSession, d: str) -> DataFrame:
    """Every container's members as an array in the order of their numbers."""
    n = F.regexp_extract("p", "_([0-9]+)>$", 1).cast("int")
    rows = rdf_store(spark, d).select(p=T.RDFS_MEMBER).groupBy("s", "o").agg(F.min(n).alias("n"))
    return rows.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "o"))), lambda x: x["o"]), " ").alias("members"))


_add("rdf_member_order", _member_order, _TERMS + ", m as (select s, o, min(cast(regexp_extract(p, '_([0-9]+)>$', 1) as int)) as n from quad where regexp_matches(p, '#_[0-9]+>$') group by 1, 2) select s, string_agg(o, ' ' order by n, o) as members from m group by 1")
_add("rdf_entities_all", lambda spark, d: rdf_store(spark, d).entities(), _TERMS + "select distinct term from (select s as term from quad union all select p from quad union all select o from quad where o_val is null union all select g from quad where g <> '')")

# reasoning
_SCHEMA = [(f"<{EX}{k}>", f"<{T.RDFS}subClassOf>", f"<{EX}{'Cheap' if k in ('SMALL', 'ECONOMY') else 'Part'}>") for k in ("PROMO", "STANDARD", "MEDIUM", "LARGE", "SMALL", "ECONOMY")] + [(f"<{EX}Cheap>", f"<{T.RDFS}subClassOf>", f"<{EX}Part>")]
_NAMES = [(f"<{EX}{p}>", f"<{T.RDFS}subPropertyOf>", f"<{EX}label>") for p in ("n_name", "r_name")]


def _part_types(spark: SparkSession, d: str) -> DataFrame:
    """Parts as instances of a class named by their p_type."""
    return quads_of(table(spark, d, "part"), F.concat(F.lit(f"<{EX}part/"), F.col("p_partkey"), F.lit(">")), F.lit(T.RDF_TYPE), F.concat(F.lit(f"<{EX}"), F.col("p_type"), F.lit(">")))


_add("rdfs_subclass", lambda spark, d: QuadStore.of(_part_types(spark, d), True).with_reasoner(RDFS(quads_from(spark, _SCHEMA))).select(p=T.RDF_TYPE, o=[f"<{EX}Cheap>", f"<{EX}Part>"]).select("s", "o"), "select '<http://ex.org/part/' || p_partkey || '>' as s, '<http://ex.org/Part>' as o from part union all select '<http://ex.org/part/' || p_partkey || '>', '<http://ex.org/Cheap>' from part where p_type in ('SMALL', 'ECONOMY')")
_add("rdfs_subclass_rewrite", lambda spark, d: WidenedStore(QuadStore.of(_part_types(spark, d)), RDFS(quads_from(spark, _SCHEMA))).query(PREFIX + "SELECT ?p { ?p a :Cheap }"), "select '<http://ex.org/part/' || p_partkey || '>' as p from part where p_type in ('SMALL', 'ECONOMY')")
_add("rdfs_subproperty", lambda spark, d: WidenedStore(mapped_store(spark, d, ["nation", "region"]), RDFS(quads_from(spark, _NAMES))).query(PREFIX + "SELECT ?x ?l { ?x :label ?l }"), """select '<http://ex.org/nation/' || n_nationkey || '>' as x, '"' || n_name || '"' as l from nation union all select '<http://ex.org/region/' || r_regionkey || '>', '"' || r_name || '"' from region""")
_add("rdfs_domain_range", lambda spark, d: mapped_store(spark, d, ["nation"]).remove(p=T.RDF_TYPE).with_reasoner(RDFS(quads_from(spark, [(f"<{EX}n_region>", f"<{T.RDFS}domain>", f"<{EX}Land>"), (f"<{EX}n_region>", f"<{T.RDFS}range>", f"<{EX}Area>")]))).select(p=T.RDF_TYPE).select("s", "o"), "select '<http://ex.org/nation/' || n_nationkey || '>' as s, '<http://ex.org/Land>' as o from nation union select '<http://ex.org/region/' || n_regionkey || '>', '<http://ex.org/Area>' from nation")


def _store_classes(spark: SparkSession, d: str) -> DataFrame:
    """Instances of t:Structure under the sub-class statements of the store itself."""
    store = rdf_store(spark, d)
    return store.with_reasoner(RDFS(store.select(p=f"<{T.RDFS}subClassOf>"))).select(p=T.RDF_TYPE, o=f"{_V}Structure>").select("s").distinct()


_add("rdfs_store_classes", _store_classes, _TERMS.replace("with named", "with recursive named", 1) + f", sub as (select '{_V}Structure>' as c union select q.s from quad q join sub on q.o = sub.c where q.p like '%#subClassOf>') select distinct s from quad where p like '%#type>' and o in (select c from sub)")


def _v(x: str) -> Var:
    return Var(x)


_PATH = [Rule([Triple(_v("a"), "<urn:next>", _v("b"))], [Triple(_v("a"), "<urn:path>", _v("b"))]), Rule([Triple(_v("a"), "<urn:path>", _v("b")), Triple(_v("b"), "<urn:path>", _v("c"))], [Triple(_v("a"), "<urn:path>", _v("c"))])]


def _rule_path_links(spark: SparkSession, d: str) -> DataFrame:
    """Reachability from child to parent over every link predicate, stated from either end, nodes of each family being
    nodes of their own. Paths join with paths, so rounds grow with the logarithm of the longest one."""
    edges = link_edges(table(spark, d, "rdf_statements"), table(spark, d, "rdf_predicates")).distinct()
    node = lambda c: F.concat(F.lit("<urn:"), F.col("family"), F.lit(":"), F.col(c).cast("string"), F.lit(">"))
    out = RuleEngine(_PATH).infer(quads_of(edges, node("child"), F.lit("<urn:next>"), node("parent")))
    return out.where("p = '<urn:path>'").select("s", "o")


_add("rule_path_links", _rule_path_links, "with recursive link as (select distinct link_family as f, case when link_direction = 'up' then subject else object end as a, case when link_direction = 'up' then object else subject end as b from rdf_statements join rdf_predicates using (predicate) where link_family is not null and objecttype = 0 and subject is not null and object is not null), path as (select f, a, b from link union select p.f, p.a, l.b from path p join link l on l.f = p.f and l.a = p.b) select '<urn:' || f || ':' || a || '>' as s, '<urn:' || f || ':' || b || '>' as o from path")


def _rule_math(relation: str, args: tuple[str, ...], out: str = "z") -> Callable[[SparkSession, str], DataFrame]:
    from quadflow.reason.rules import Call

    def run(spark: SparkSession, d: str) -> DataFrame:
        body = [Triple(_v("p"), f"<{EX}p_size>", _v("x")), Triple(_v("p"), f"<{EX}p_retailprice>", _v("y")), Call(relation, tuple(_v(a) for a in args), _v(out))]
        found = RuleEngine([Rule(body, [Triple(_v("p"), "<urn:out>", _v("z" if out == "z" else "x"))])]).infer(mapped_store(spark, d, ["part"]).quads)
        return found.where("p = '<urn:out>'").select("s", T.c_text(F.col("o")).cast("double").alias("z"))

    return run


for _name, _relation, _args, _value in [
    ("sum", "sum", ("x", "y"), "p_size + p_retailprice"),
    ("product", "product", ("x", "y"), "p_size * p_retailprice"),
    ("difference", "difference", ("y", "x"), "p_retailprice - p_size"),
    ("rounded", "rounded", ("y",), "floor(p_retailprice)"),
    ("remainder", "remainder", ("y", "x"), "fmod(p_retailprice, p_size)"),
    ("integer_quotient", "integerQuotient", ("y", "x"), "floor(p_retailprice / p_size)"),
    ("negation", "negation", ("x",), "-p_size"),
]:
    _add(f"rule_math_{_name}", (lambda f: lambda spark, d: f(spark, d).withColumn("z", F.round("z", 6)))(_rule_math(_relation, _args)), f"select '<http://ex.org/part/' || p_partkey || '>' as s, round(cast({_value} as double), 6) as z from part")

# functions, blank nodes
_sparql("udf_lc", "customer", 'SELECT ?c { ?c :c_mktsegment ?m FILTER(fn:lc(?m) = "building") }', "select c_custkey as c from customer where lower(c_mktsegment) = 'building'")
_sparql("udf_uc", "part", 'SELECT ?p { ?p :p_name ?n FILTER(fn:uc(?n) = "RED WIDGET") }', "select p_partkey as p from part where upper(p_name) = 'RED WIDGET'")
# every statement of the store by its real blank nodes; tests/test_msg_store.py has the brute force
_add("msg_store", lambda spark, d: msgs(rdf_store(spark, d).quads).select("s", "p", "o", "g", "msg"))


def _lean(spark: SparkSession, d: str) -> DataFrame:
    """Customers as blank nodes known by nation and segment only: one of each kind says it all."""
    c = table(spark, d, "customer")
    node = F.concat(F.lit("_:c"), F.col("c_custkey").cast("string"))
    parts = [quads_of(c, node, F.lit(f"<{EX}{n}>"), T.c_literal(F.col(n).cast("string"))) for n in ("c_nationkey", "c_mktsegment")]
    return make_lean(parts[0].unionByName(parts[1])).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


_add("lean_customers", _lean, "select unnest(['<http://ex.org/c_nationkey>', '<http://ex.org/c_mktsegment>']) as p, (select count(*) from (select distinct c_nationkey, c_mktsegment from customer)) as n")


def _lean_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Customers as graphs of two blank nodes: one of a segment, in another of a nation."""
    c = table(spark, d, "customer")
    node = lambda k: F.concat(F.lit(f"_:{k}"), F.col("c_custkey").cast("string"))
    parts = [quads_of(c, node("c"), F.lit(f"<{EX}c_mktsegment>"), T.c_literal(F.col("c_mktsegment"))), quads_of(c, node("c"), F.lit(f"<{EX}c_nation>"), node("n")), quads_of(c, node("n"), F.lit(f"<{EX}c_nationkey>"), T.c_literal(F.col("c_nationkey").cast("string")))]
    return make_lean(reduce(DataFrame.unionByName, parts)).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


_add("lean_customer_pairs", _lean_pairs, "select unnest(['<http://ex.org/c_nationkey>', '<http://ex.org/c_nation>', '<http://ex.org/c_mktsegment>']) as p, (select count(*) from (select distinct c_nationkey, c_mktsegment from customer)) as n")
