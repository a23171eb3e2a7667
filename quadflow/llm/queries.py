"""Queries p3, p4, p5, p8, p9 and p10, and SQL that gives the same rows where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadflow.llm.copies import copy_groups, normalized
from quadflow.llm.frequency import marked, term_frequencies, value_terms
from quadflow.llm.lookalikes import alike_pairs, confusables, form_sql, one_form
from quadflow.llm.mixing import demands, mixture, reached
from quadflow.llm.packing import fill, pack
from quadflow.llm.subjects import composition, fitted, page_areas
from quadflow.llm.tokens import with_tokens
from quadflow.runtime import table, written


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    statements, entities = table(spark, d, "rdf_statements"), table(spark, d, "rdf_entities")
    predicates = statements.select(F.lit("predicate").alias("field_name"), F.col("predicate").cast("string").alias("term"), F.col("subject").alias("record"), F.lit(1).cast("bigint").alias("n"))
    totals = statements.select(F.lit("predicate").alias("field_name"), F.col("subject").alias("record")).unionByName(entities.select(F.lit("value").alias("field_name"), F.col("id").alias("record")))
    totals = totals.where("record is not null").distinct().groupBy("field_name").agg(F.count(F.lit(1)).alias("total"))
    return marked(term_frequencies(predicates.unionByName(value_terms(entities, "value", "id", "value"))), totals)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_terms(spark, d).where("mark is not null").select("field_name", "term", "mark")


def _plain_texts(spark: SparkSession, d: str) -> DataFrame:
    string = normalized(F.lit("http://www.w3.org/2001/XMLSchema#string"))
    return table(spark, d, "rdf_literals").where(F.col("datatype").isNull() | (normalized(F.col("datatype")) == string))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copy_groups(_plain_texts(spark, d)).where("kept_id <> copy_id")


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return copy_groups(_plain_texts(spark, d)).groupBy("kept_id").agg(F.count(F.lit(1)).alias("n_copies"))


def _alike(spark: SparkSession, d: str, name: str, same: tuple[str, ...]) -> DataFrame:
    rows = table(spark, d, name).select("id", "value", *same)
    return alike_pairs(one_form(rows, "value"), same).select(F.lit(name).alias("table_name"), "id_a", "id_b")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _alike(spark, d, "rdf_entities", ()).unionByName(_alike(spark, d, "rdf_literals", ("language", "datatype")))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = [table(spark, d, t).select(F.lit(t).alias("table_name"), "id", "value") for t in ("rdf_entities", "rdf_literals")]
    return one_form(rows[0].unionByName(rows[1]).distinct(), "value")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, n_tokens) of every page, tokenized once."""
    return written(with_tokens(table(spark, d, "documents").select("doc_id", "source", "text")), "tokens")


def _limits(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    return [(r["profile"], r["capacity_tokens"]) for r in table(spark, d, "pack_limits").collect()]  # a fixed few profiles


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(_pages(spark, d).select(F.col("doc_id").alias("item_id"), F.col("n_tokens").alias("size")), _limits(spark, d))


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnsRenamed({"item_id": "doc_id", "size": "n_tokens"})


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill(_packed(spark, d), _limits(spark, d))


def p8_properties(spark: SparkSession, d: str) -> DataFrame:
    """Per profile what must hold exactly: no window above the capacity, no page split that fits, no token lost or doubled."""
    pages, limits = _pages(spark, d), table(spark, d, "pack_limits")
    packed = pack(pages.select(F.col("doc_id").alias("item_id"), F.col("n_tokens").alias("size")), _limits(spark, d)).join(limits, "profile")
    windows = packed.groupBy("profile", "window", "capacity_tokens").agg(F.sum("size").alias("used"))
    over = windows.groupBy("profile").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("over_capacity"))
    whole = packed.groupBy("profile", "item_id", "capacity_tokens").agg(F.sum("size").alias("got"), F.count(F.lit(1)).alias("pieces")).join(pages.select(F.col("doc_id").alias("item_id"), "n_tokens"), "item_id")
    kept = whole.groupBy("profile").agg(F.count_if((F.col("n_tokens") <= F.col("capacity_tokens")) & (F.col("pieces") > 1)).alias("split_though_fitting"), F.count_if(F.col("got") != F.col("n_tokens")).alias("unlike_their_size"), F.count(F.lit(1)).alias("pages"))
    return over.join(kept, "profile")


def p9_properties(spark: SparkSession, d: str) -> DataFrame:
    """Per profile and source whether it has its demand but for half a page, and no page is used too often."""
    pages, targets = _pages(spark, d), table(spark, d, "mix_targets")
    got = reached(mixture(pages, targets), pages, targets)
    want = demands(pages, targets).select("profile", "source", "demand").join(pages.groupBy("source").agg(F.max("n_tokens").alias("longest")), "source", "left")
    rows = got.join(want, ["profile", "source"])
    return rows.select("profile", "source", (F.abs(F.col("n_tokens") - F.col("demand")) <= F.coalesce(F.col("longest"), F.lit(0)) / 2 + 1).alias("on_target"), (F.col("max_use") <= F.col("max_repeats")).alias("within_repeats"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(_pages(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    pages, targets = _pages(spark, d), table(spark, d, "mix_targets")
    return reached(mixture(pages, targets), pages, targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return page_areas(docs, fitted(docs, table(spark, d, "page_labels"), table(spark, d, "subject_areas")))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return composition(p10_found(spark, d), table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_terms, p4_found, p4_records, p5_found, p5_forms, p8_windows, p8_fill, p8_properties, p9_mixture, p9_shares, p9_properties, p10_found, p10_composition)}

_TERMS = """with t as (select 'predicate' as field_name, cast(predicate as varchar) as term, subject as record from rdf_statements where predicate is not null and subject is not null
  union all select 'value', lower(unnest(regexp_extract_all(value, '[A-Za-z]+'))), id from (select distinct id, value from rdf_entities where id is not null)),
total as (select 'predicate' as field_name, count(distinct subject) as total from rdf_statements union all select 'value', count(distinct id) from rdf_entities),
freq as (select field_name, term, count(*) as occurrences, count(distinct record) as records from t group by 1, 2),
marked as (select freq.*, total, case when records >= 0.5 * total then 'common' when records <= 3 then 'rare' end as mark from freq join total using (field_name))
"""
_BARE = "lower(regexp_replace({}, '[\\pP\\pZ\\t\\n\\v\\f\\r\\x{{85}}]+', '', 'g'))"
_COPIES = f"""with r as (select distinct id, list_sort(list_filter(list_transform(string_split(value, ';'), lambda x: {_BARE.format("x")}), lambda x: x <> '')) as v, value is null as n,
  {_BARE.format("language")} as l, {_BARE.format("datatype")} as d from rdf_literals where datatype is null or {_BARE.format("datatype")} = {_BARE.format("'http://www.w3.org/2001/XMLSchema#string'")}),
g as (select id, min(id) over (partition by v, n, l, d) as kept_id from r)
"""
SQL = {
    "p3_terms": _TERMS + "select * from marked",
    "p3_found": _TERMS + "select field_name, term, mark from marked where mark is not null",
    "p4_found": _COPIES + "select distinct kept_id, id as copy_id from g where id <> kept_id",
    "p8_properties": "select profile, cast(0 as bigint) as over_capacity, cast(0 as bigint) as split_though_fitting, cast(0 as bigint) as unlike_their_size, (select count(*) from documents) as pages from pack_limits",
    "p9_properties": "select profile, source, true as on_target, true as within_repeats from mix_targets",
    "p4_records": _COPIES + "select kept_id, count(distinct id) as n_copies from g group by 1",
}


def session_sql() -> dict[str, str]:
    """SQL of p5, whose tables of characters need a session; none without one."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return {}
    form = form_sql("value", confusables(spark)[1])
    pairs = []
    for name, same in (("rdf_entities", ()), ("rdf_literals", ("language", "datatype"))):
        rows = f"(select distinct id, value, {', '.join([*same, form + ' as f'])} from {name} where id is not null and value is not null)"
        on = " and ".join(["a.f = b.f", "a.value <> b.value", "a.id < b.id", *[f"a.{c} is not distinct from b.{c}" for c in same]])
        pairs.append(f"select distinct '{name}' as table_name, a.id as id_a, b.id as id_b from {rows} a join {rows} b on {on}")
    forms = " union all ".join(f"select '{t}' as table_name, id, value from {t}" for t in ("rdf_entities", "rdf_literals"))
    return {"p5_found": " union all ".join(pairs), "p5_forms": f"select table_name, id, value, {form} as one_form from (select distinct * from ({forms}))"}
