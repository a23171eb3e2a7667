"""Queries p1, p2, p6 and p7 over the tables of an RDF store, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadflow.operators.hierarchy import all_descendants, descendants, hierarchy, link_edges
from quadflow.operators.orphans import orphan_report, orphans, references, spans
from quadflow.operators.pivot import cell_values, unfilled, wide_table
from quadflow.operators.skew import heavy_keys, key_rows, key_stats
from quadflow.runtime import table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return link_edges(table(spark, d, "rdf_statements"), table(spark, d, "rdf_predicates"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(_edges(spark, d)).select("family", "node_id", "root_id", "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(_edges(spark, d)).select("family", "node_id", "parent_id", "root_id", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(hierarchy(_edges(spark, d)))


def p1_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """p1_descendants and the pairs of the nodes on and below loops."""
    return all_descendants(hierarchy(_edges(spark, d)))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    predicates = table(spark, d, "rdf_predicates")
    columns = predicates.where("column_name is not null and column_type is not null").selectExpr("column_name", "column_type", "coalesce(single_valued, false) as single_valued")
    return wide_table(cell_values(table(spark, d, "rdf_statements"), predicates, table(spark, d, "rdf_literals")), columns)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return unfilled(_wide(spark, d))


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d)


def p2_wide_text(spark: SparkSession, d: str) -> DataFrame:
    """p2_wide with every cell as text, arrays parted by a line break."""
    wide = _wide(spark, d)
    text = lambda c, t: F.array_join(F.col(c).cast("array<string>"), "\n") if t.startswith("array") else F.regexp_replace(F.col(c).cast("string"), r"\.?0+$", "") if t == "decimal(38,18)" else F.format_string("%.6e", F.col(c)) if t == "double" else F.col(c).cast("string")
    return wide.select(*[F.when(F.col(c).isNotNull(), text(c, t)).alias(c) for c, t in wide.dtypes if not c.endswith("__exact")])


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans(spans(*[table(spark, d, t) for t in ("rdf_entities", "rdf_bnodes", "rdf_literals")]), references(table(spark, d, "rdf_statements")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("stmt_id", "side", "state")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d)).withColumn("period", F.date_format("period", "yyyy-MM"))


def p7_stats(spark: SparkSession, d: str) -> DataFrame:
    return key_stats(key_rows(table(spark, d, "rdf_statements"), ["predicate", "meta"], "added_at", "stmt_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    statements = table(spark, d, "rdf_statements")
    return heavy_keys(p7_stats(spark, d), statements.count())


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_all_descendants, p2_found, p2_wide, p2_wide_text, p6_found, p6_report, p7_found, p7_stats)}

_LINKS = """
link as (select link_family as family, case when link_direction = 'up' then subject else object end as child,
  min(case when link_direction = 'up' then object else subject end) as parent
  from rdf_statements join rdf_predicates using (predicate)
  where link_family is not null and objecttype = 0 and subject is not null and object is not null group by 1, 2)
"""
_TREE = f"""with recursive {_LINKS},
tree as (
  select distinct family, parent as node_id, cast(null as bigint) as parent_id, parent as root_id, cast(0 as bigint) as depth, cast(parent as varchar) as path
  from link l where not exists (select 1 from link k where k.family = l.family and k.child = l.parent)
  union all
  select l.family, l.child, l.parent, t.root_id, t.depth + 1, t.path || '/' || l.child from tree t join link l on l.family = t.family and l.parent = t.node_id),
stray as (select * from link l where not exists (select 1 from tree t where t.family = l.family and t.node_id = l.child)),
walk as (
  select family, child as start, parent as node from stray
  union
  select w.family, w.start, s.parent from walk w join stray s on s.family = w.family and s.child = w.node),
onloop as (select family, start as node from walk where node = start),
looped as (select w.family, w.start as node_id, min(w.node) as root_id from walk w join onloop o on o.family = w.family and o.node = w.node group by 1, 2)
"""
_WHOLE = "nullif(ltrim(regexp_extract(t, '^[+-]?([0-9]*)', 1), '0'), '')"
_PART = "nullif(rtrim(regexp_extract(t, '\\.([0-9]*)$', 1), '0'), '')"
_CELLS = f"""with feed as (select distinct predicate, column_name, column_type from rdf_predicates where column_name is not null and single_valued),
val as (
  select distinct s.subject, f.column_name, f.column_type, case when s.objecttype = 1 then regexp_replace(l.value, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') end as t
  from rdf_statements s join feed f using (predicate) left join (select distinct id, value from rdf_literals) l on s.objecttype = 1 and l.id = s.object
  where s.objecttype = 0 or l.id is not null),
typed as (select subject, column_name, case
  when column_type in ('integer', 'decimal') and regexp_matches(t, case when column_type = 'integer' then '^[+-]?[0-9]+$' else '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)$' end)
    then case when t[1] = '-' and ({_WHOLE} is not null or {_PART} is not null) then '-' else '' end || coalesce({_WHOLE}, '0') || coalesce('.' || {_PART}, '')
  when column_type = 'double' and regexp_matches(t, '^([+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$') then cast(try_cast(t as double) + 0 as varchar)
  when column_type = 'boolean' and t in ('true', '1') then 'true' when column_type = 'boolean' and t in ('false', '0') then 'false'
  when column_type = 'date' and regexp_matches(t, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then cast(try_cast(t as date) as varchar) end as v from val)
"""
#: The columns of rdf_predicates, the same at every scale: name -> type, with * for many values.
_COLUMNS = {"alt_label": "string*", "area_km2": "decimal", "description": "string*", "entry_fee": "decimal", "founded_on": "date", "height_cm": "integer", "is_listed": "boolean", "is_open": "boolean", "label": "string*", "population": "integer", "rating": "double", "seats": "integer", "surveyed_on": "date"}
_ALL_CELLS = _CELLS.replace("column_name is not null and single_valued", "column_name is not null").replace("end as t\n", "end as t, l.value as raw\n").replace("end as v from val", "when column_type = 'string' then raw end as v from val").replace("cast(try_cast(t as double) + 0 as varchar)", "case when isnan(try_cast(t as double)) then 'NaN' when isinf(try_cast(t as double)) then if(t[1] = '-', '-Infinity', 'Infinity') else printf('%.6e', try_cast(t as double) + 0) end")


def _pick(name: str, kind: str) -> str:
    mine = f"filter (where column_name = '{name}')"
    if kind.endswith("*"):
        return f"case when count(*) {mine} > 0 then coalesce(string_agg(distinct v, chr(10) order by v) {mine}, '') end as {name}"
    state = f"case when count(*) {mine} = 0 then null when count(v) {mine} = 0 then 'unreadable' when count(distinct v) {mine} > 1 then 'conflict' else 'ok' end"
    return f"case when count(distinct v) {mine} = 1 then min(v) {mine} end as {name}, {state} as {name}__state"


_REFS = """with ref as (
  select stmt_id, added_at as moment, 'subject' as side, 'resource' as parent_table, subject as key from rdf_statements where subject is not null
  union all select stmt_id, added_at, 'object', case objecttype when 0 then 'resource' else 'literal' end, object from rdf_statements where object is not null and objecttype in (0, 1)),
span as (select 'resource' as parent_table, id, added_at, removed_at from rdf_entities union all select 'resource', id, added_at, null from rdf_bnodes
  union all select 'literal', id, added_at, removed_at from rdf_literals),
judged as (select stmt_id, side, r.parent_table, key, moment, count(id) as n, count(*) filter (where added_at <= moment and (removed_at is null or moment < removed_at)) as holding, count(*) filter (where added_at <= moment) as added
  from ref r left join span s on s.parent_table = r.parent_table and s.id = r.key group by all),
orphan as (select stmt_id, side, parent_table, key, moment, case when n = 0 then 'missing' when added > 0 then 'deleted' else 'late' end as state from judged where holding = 0 and (n = 0 or moment is not null))
"""
_KEYED = """with keyed as (select 'predicate' as field_name, predicate as key_id, epoch_us(added_at) as us, stmt_id from rdf_statements
  union all select 'meta', meta, epoch_us(added_at), stmt_id from rdf_statements)
"""
SQL = {
    "p1_found": _TREE + "select family, node_id, root_id, depth from tree union all select family, node_id, root_id, cast(-1 as bigint) from looped",
    "p1_paths": _TREE + "select family, node_id, parent_id, root_id, depth, path from tree union all select family, node_id, parent, root_id, cast(-1 as bigint), null from looped join stray using (family) where stray.child = node_id",
    "p1_descendants": _TREE
    + ", pair as (select family, parent as ancestor_id, child as node_id, cast(1 as bigint) as distance from link semi join tree on tree.family = link.family and tree.node_id = link.child union all select p.family, l.parent, p.node_id, p.distance + 1 from pair p join link l on l.family = p.family and l.child = p.ancestor_id) select * from pair",
    "p2_found": _CELLS + "select subject, column_name, case when count(v) = 0 then 'unreadable' else 'conflict' end as state from typed group by 1, 2 having count(v) = 0 or count(distinct v) > 1",
    "p2_wide_text": _ALL_CELLS + "select cast(subject as varchar) as subject, " + ", ".join(_pick(c, t) for c, t in _COLUMNS.items()) + " from typed group by typed.subject",
    "p6_found": _REFS + "select stmt_id, side, state from orphan",
    "p6_report": _REFS + "select parent_table, side, state, strftime(moment at time zone 'UTC', '%Y-%m') as period, count(*) as n_refs, count(distinct key) as n_keys from orphan group by all",
    "p7_found": _KEYED + "select field_name, key_id from keyed where key_id is not null group by 1, 2 having count(*) >= 0.05 * (select count(*) from rdf_statements)",
    "p7_stats": _KEYED
    + ", gap as (select *, us - lag(us) over (partition by field_name, key_id order by us nulls first, stmt_id) as g from keyed) select field_name, key_id, count(*) as n_rows, min(us) as first_us, max(us) as last_us, max(g) as max_gap_us from gap group by 1, 2",
}
SQL["p1_all_descendants"] = (
    SQL["p1_descendants"].removesuffix(" select * from pair")
    + """, chain as (select family, parent as ancestor_id, child as node_id, cast(1 as bigint) as distance, [child, parent] as seen from stray where child <> parent
  union all select c.family, s.parent, c.node_id, c.distance + 1, list_append(c.seen, s.parent) from chain c join stray s on s.family = c.family and s.child = c.ancestor_id where not list_contains(c.seen, s.parent))
  select * from pair union all select family, ancestor_id, node_id, distance from chain"""
)
