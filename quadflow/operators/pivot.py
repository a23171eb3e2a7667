"""Attribute-value rows to wide tables: typed narrow tables, co-partitioned by entity, joined in a balanced tree of outer joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadflow.runtime import scratch, small

#: Lexical forms of XML Schema.
LEXICAL = {
    "integer": r"^[+-]?[0-9]+$",
    "decimal": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$",
    "double": r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$",
    "boolean": r"^(true|false|1|0)$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
}
SPARK_TYPE = {"integer": "decimal(38,0)", "decimal": "decimal(38,18)", "double": "double", "boolean": "boolean", "date": "date", "string": "string"}

#: Narrow tables that are joined to the subjects one after the other before the groups are put together.
GROUP = 4


def _canonical(text: Column, kind: Column) -> Column:
    """One text for each typed value, null for texts that are no lexical form of the type."""

    def number(t: Column) -> Column:
        whole = F.regexp_replace(F.regexp_extract(t, r"^[+-]?([0-9]*)", 1), "^0+", "")
        part = F.regexp_replace(F.regexp_extract(t, r"\.([0-9]*)$", 1), "0+$", "")
        zero = (whole == "") & (part == "")
        return F.concat(F.when(t.startswith("-") & ~zero, "-").otherwise(""), F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))

    real = F.when(text.endswith("INF"), F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).when(text == "NaN", F.lit(float("nan"))).otherwise(text.try_cast("double"))
    out = F.when(kind == "string", text)
    for k in ("integer", "decimal"):
        out = out.when((kind == k) & text.rlike(LEXICAL[k]), number(text))
    out = out.when((kind == "double") & text.rlike(LEXICAL["double"]), (real + F.lit(0.0)).cast("string"))
    out = out.when((kind == "boolean") & text.rlike(LEXICAL["boolean"]), F.when(text.isin("true", "1"), "true").otherwise("false"))
    return out.when((kind == "date") & text.rlike(LEXICAL["date"]), text.try_cast("date").cast("string"))


def cell_values(statements: DataFrame, predicates: DataFrame, literals: DataFrame) -> DataFrame:
    """(subject, column_name, column_type, single_valued, typed): one row per value, typed null if unreadable.

    A literal id without a row in literals is no value; an entity as object, and a literal whose text is null, is an
    unreadable one. Text is trimmed of spaces, tabs and line breaks unless its column is of strings.
    """
    feeds = predicates.where("column_name is not null and column_type is not null").select("predicate", "column_name", "column_type", F.coalesce("single_valued", F.lit(False)).alias("single_valued")).distinct()
    cells = statements.where("subject is not null and objecttype in (0, 1)").select("subject", "predicate", "objecttype", "object").join(small(feeds), "predicate").drop("predicate")
    texts = literals.where("id is not null").select(F.col("id").alias("object"), "value").distinct()
    read = cells.where("objecttype = 1").join(texts, "object").select(
        "subject", "column_name", "column_type", "single_valued",
        _canonical(F.when(F.col("column_type") == "string", F.col("value")).otherwise(F.regexp_replace("value", r"^[ \t\r\n]+|[ \t\r\n]+$", "")), F.col("column_type")).alias("typed"),
    )
    return read.unionByName(cells.where("objecttype = 0").select("subject", "column_name", "column_type", "single_valued", F.lit(None).cast("string").alias("typed")))


def narrow_tables(cells: DataFrame) -> DataFrame:
    """(subject, state, exact, in_integer, in_decimal, in_double, in_boolean, in_date, in_string, many, column_name), one row
    per cell, in a folder per column: the value stands in the field of its column's type, the others are null.

    exact is the text of a number that its field cannot hold as it is; many has the texts of a column of many values.
    """
    one = F.when(F.col("low") == F.col("high"), F.col("low"))
    typed = {k: (one if k == "string" else one.try_cast(t)) for k, t in SPARK_TYPE.items()}
    fields = [F.when(F.col("column_type") == k, c).alias(f"in_{k}") for k, c in typed.items()]
    state = F.when(F.col("low").isNull(), "unreadable").when(F.col("low") != F.col("high"), "conflict").when(F.col("exact").isNotNull(), "inexact").otherwise("ok")
    fits = F.when(F.col("column_type") == "integer", _fits(one, "integer")).when(F.col("column_type") == "decimal", _fits(one, "decimal")).otherwise(True)
    single = cells.where("single_valued").groupBy("subject", "column_name").agg(F.first("column_type").alias("column_type"), F.min("typed").alias("low"), F.max("typed").alias("high"))
    single = single.withColumn("exact", F.when(~fits, one))
    none = F.lit(None).cast("array<string>")
    many = cells.where("not single_valued").groupBy("subject", "column_name").agg(F.array_sort(F.collect_set("typed")).alias("many"))
    empty = [F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("exact"), *[F.lit(None).cast(t).alias(f"in_{k}") for k, t in SPARK_TYPE.items()]]
    rows = single.select("subject", state.alias("state"), "exact", *fields, none.alias("many"), "column_name")
    # a number that does not fit is no value of its field
    rows = rows.withColumns({f"in_{k}": F.when(F.col("exact").isNull(), F.col(f"in_{k}")) for k in ("integer", "decimal")})
    out = rows.unionByName(many.select("subject", *empty, "many", "column_name"))
    path = scratch(cells.sparkSession, "narrow")
    out.write.partitionBy("column_name").parquet(path)
    return cells.sparkSession.read.schema(out.schema).parquet(path)


def _fits(text: Column, kind: str) -> Column:
    """Whether the field of a kind of number holds a canonical text as it is."""
    return text.isNull() | text.rlike(r"^-?[0-9]{1,38}$" if kind == "integer" else r"^-?[0-9]{1,20}(\.[0-9]{1,18})?$")


def wide_table(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per subject: for every column c its typed value c and, if single-valued, c__state; for integers and
    decimals also c__exact.

    cells: as of cell_values(); columns: (column_name, column_type, single_valued), one row per column of the result;
    names must be fit for columns and not "subject". State is "ok", "conflict" (more than one distinct typed value; the
    cell is null), "unreadable" (only unreadable values; null), "inexact" or null (no value). Columns that are not
    single-valued hold the sorted array of their distinct readable values. Integers have up to 38 digits, decimals up to
    20 before and 18 behind the point; a number beyond is "inexact", its cell null and its canonical text in c__exact
    (for columns of many values the array of such texts). A subject all of whose values are unreadable has a row. No
    cells: no rows.

    Cells are aggregated before they are exchanged and written as narrow tables, typed, one per column. Each is exchanged
    once by subject and outer-joined to the subjects there are, which are exchanged alike; as these are on the keeping
    side, the joins that put the groups together in a balanced tree find everything in place, whatever their number.
    """
    kinds = sorted((r["column_name"], r["column_type"], bool(r["single_valued"])) for r in columns.distinct().collect())  # a schema: as many rows as the result has columns
    narrow = narrow_tables(cells)
    subjects = narrow.select("subject").distinct()
    groups: list[DataFrame] = []
    for i in range(0, len(kinds), GROUP):
        group = subjects
        for column, kind, one in kinds[i : i + GROUP]:
            t, number = narrow.where(F.col("column_name") == column), kind in ("integer", "decimal")
            if one:
                t = t.select("subject", F.col(f"in_{kind}").alias(column), F.col("state").alias(f"{column}__state"), *([F.col("exact").alias(f"{column}__exact")] if number else []))
            elif number:
                held = F.transform(F.filter("many", lambda x, k=kind: _fits(x, k)), lambda x, k=kind: x.cast(SPARK_TYPE[k]))
                t = t.select("subject", held.alias(column), F.filter("many", lambda x, k=kind: ~_fits(x, k)).alias(f"{column}__exact"))
            else:
                t = t.select("subject", (F.col("many") if kind == "string" else F.transform("many", lambda x, k=kind: x.try_cast(SPARK_TYPE[k]))).alias(column))
            group = group.join(t, "subject", "left")
        groups.append(group)
    while len(groups) > 1:
        groups = [a.join(b, "subject") if b is not None else a for a, b in zip(groups[::2], [*groups[1::2], *[None] * (len(groups) % 2)], strict=True)]
    return groups[0] if groups else subjects


def unfilled(wide: DataFrame) -> DataFrame:
    """(subject, column_name, state) of the single-valued cells of wide_table() that have values but no single one."""
    states = [c for c in wide.columns if c.endswith("__state")]
    if not states:
        return wide.selectExpr("subject", "'' as column_name", "'' as state").limit(0)
    pairs = F.array(*[F.struct(F.lit(c[:-7]).alias("column_name"), F.col(c).alias("state")) for c in states])
    return wide.select("subject", F.explode(F.filter(pairs, lambda x: x["state"].isin("conflict", "unreadable"))).alias("x")).select("subject", "x.column_name", "x.state")
