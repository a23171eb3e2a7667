"""Visually identical text: one consistent form, by DuckDB SQL inside Arrow partitions."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quadflow.runtime import scratch, written

# Letters of other scripts, each beside the Latin letter it looks like, which count before the public table
# of confusable characters.
OTHER_SCRIPTS = (
    # Greek
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ρp ϲc ϳj ϹC ͿJ "
    # Cyrillic
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԌG ԚQ ԜW ӀI аa еe іi јj оo рp сc уy хx ѕs һh ԁd ԛq ԝw үy ӏl "
    # Armenian
    "ՏS ՕO օo սu հh ոn զq "
    # Latin letters beside the alphabet
    "ɡg ɑa"
)
#: What is not seen: formatting characters, variation selectors and the grapheme joiner.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFF9}-\x{FFFB}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}]"
#: Bytes of text that DuckDB gets at a time.
SLICE = 4 << 20
#: Non-breaking and fixed-width spaces.
SPACES = r"[\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


@cache
def confusables(spark: SparkSession) -> tuple[str, dict[str, str]]:
    """The version and, of the Unicode Consortium's table of confusable characters (UTS 39) as ICU4J has it, which Spark
    brings along, all letters that look like one Latin letter: letter -> Latin letter.

    The table folds I, l, 1 and | into one; here a capital counts as I, any other letter as l.
    """
    jvm = spark.sparkContext._jvm
    checker = getattr(jvm, "com.ibm.icu.text.SpoofChecker$Builder")().build()
    letters = [chr(c) for c in range(0xA1, 0x110000) if unicodedata.category(chr(c))[0] == "L" and not 0x3400 <= c < 0xA000 and not 0xAC00 <= c < 0xD7B0 and not 0x20000 <= c < 0x40000]
    plain = dict(zip([chr(c) for c in range(0x41, 0x7B) if chr(c).isalpha()], checker.getSkeleton("\n".join(chr(c) for c in range(0x41, 0x7B) if chr(c).isalpha())).split("\n"), strict=True))
    back = {s: a for a, s in plain.items() if len(s) == 1}  # of I and l, which look the same there, the later one
    out = {}
    for c, s in zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True):
        if s in back and c != "ſ":
            out[c] = "I" if back[s] == "l" and unicodedata.category(c) == "Lu" else back[s]
    return f"Unicode {jvm.com.ibm.icu.lang.UCharacter.getUnicodeVersion().toString()}, ICU4J {jvm.com.ibm.icu.util.VersionInfo.ICU_VERSION.toString()}", out


def tables(others: dict[str, str] | None = None) -> tuple[str, str, list[tuple[str, str]]]:
    """From and to of translate(), and the joined letters with what they join; made from the Unicode data by rule.

    A compatibility form that prints as its plain form (wide, narrow, font, and letters or signs marked compat) counts;
    superscripts, circles, fractions, squares and the long s do not. Letters of other scripts, those listed above and
    others, carry their accents along.
    """
    like = (others or {}) | {p[0]: p[1] for p in OTHER_SCRIPTS.split()}
    one, many = dict(like), {}
    for code in [*range(0xA1, 0x3400), *range(0xA640, 0xABFF), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        c = chr(code)
        if c in one or c == "ſ" or unicodedata.category(c) in ("Zs", "Cn", "Cs", "Co", "Cf"):
            continue
        tag, plain = unicodedata.decomposition(c).partition(" ")[0], c
        if tag in ("<wide>", "<narrow>", "<font>") or tag == "<compat>" and (unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nl"):
            plain = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFKD", c)))
        elif tag and tag[0] != "<":
            whole = unicodedata.normalize("NFD", c)
            if whole[0] in like:
                plain = unicodedata.normalize("NFC", like[whole[0]] + whole[1:])
        plain = unicodedata.normalize("NFC", "".join(like.get(x, x) for x in plain))
        if plain != c and not any(x.isspace() for x in plain):
            if len(plain) == 1:
                one[c] = plain
            else:
                many[c] = plain
    return "".join(one), "".join(one.values()), sorted(many.items())


def form_sql(column: str, others: dict[str, str] | None = None) -> str:
    """DuckDB's expression for the one form of a text column; others: further letters with the Latin ones they look like."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    old, new, joined = tables(others)
    seen = f"regexp_replace(regexp_replace({column}, '{INVISIBLE}', '', 'g'), '{SPACES}', ' ', 'g')"
    # joined letters are rare; the chain of replacements runs only for texts that have one
    parted = seen
    for a, b in joined:
        parted = f"replace({parted}, {quote(a)}, {quote(b)})"
    some = f"case when regexp_matches({column}, {quote('[' + ''.join(a for a, _ in joined) + ']')}) then {parted} else {seen} end"
    other = f"nfc_normalize(translate(nfc_normalize({some}), {quote(old)}, {quote(new)}))"
    return f"case when {column} is null or regexp_full_match({column}, '[\\x00-\\x7F]*') then {column} else {other} end"


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about SLICE bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    part = np.cumsum(sizes) // SLICE
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)], strict=True)


def _forms(sql: str, spill: str):  # noqa: ANN202
    """Each batch with the form of its last column in place of it; DuckDB sees that column alone, whatever the others are,
    some bytes at a time, and may spill into the shared folder where that is a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        config = {"threads": 1, "memory_limit": "512MB", "temp_directory": f"/{spill[5:].lstrip('/')}/{uuid.uuid4().hex}" if spill.startswith("file:") else ""}
        with duckdb.connect(config=config) as con:
            con.execute(f"create macro one_form(t) as ({sql})")
            for b in batches:
                if not b.num_rows:
                    continue
                made = []
                for i, j in _slices(b.column(b.num_columns - 1)):
                    con.register("part", pa.table({"i": pa.array(range(j - i), pa.int32()), "t": b.column(b.num_columns - 1).slice(i, j - i)}))
                    made += con.sql("select one_form(t) as f from part order by i").to_arrow_table().column("f").cast(pa.string()).chunks
                    con.unregister("part")
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.chunked_array(made, pa.string()).combine_chunks()], names=[*b.schema.names[:-1], "one_form"])

    return run


def one_form(rows: DataFrame, column: str) -> DataFrame:
    """rows with one_form: the text of the column in one consistent form; null for null, an empty text stays empty.

    Wide and font forms, joined letters, letters of other scripts (all that confusables() has), separate accents, invisible
    characters and non-breaking spaces are mapped; spaces, tabs, line breaks, letter case and accents themselves are kept. A column
    one_form that rows have already is replaced; other columns, the text among them, come through as they are.
    """
    kept = [f for f in rows.schema.fields if f.name.lower() != "one_form"]
    schema = StructType([*kept, StructField("one_form", StringType())])
    run = _forms(form_sql("t", confusables(rows.sparkSession)[1]), scratch(rows.sparkSession, "duckdb"))
    return rows.select(*[f"`{f.name}`" for f in kept], F.col(f"`{column}`").alias("one_form")).mapInArrow(run, schema)


def _key(*columns: str) -> Column:
    """A 64-bit hash in which null differs from every text."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def alike_pairs(rows: DataFrame, same: tuple[str, ...] = ()) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of ids with different texts of one form, the columns in same being equal (null to null).

    rows: (id, value, one_form, *same); null ids or values are left out, repeated rows count once, an id is no pair with
    itself. Forms that only one text has are dropped on two 64-bit hashes before any text is exchanged. Pairs are made
    between the distinct texts of a form and only then spread to their ids, so ids that share a text, however many,
    never meet.
    """
    kept = written(rows.where("id is not null and value is not null").select("id", "value", "one_form", *same), "forms").withColumn("k", _key("one_form", *same)).withColumn("v", F.xxhash64("value"))
    several = kept.groupBy("k").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low < high").select("k")
    members = written(kept.join(several, "k", "left_semi").distinct(), "alike")
    texts = members.select("k", "value", "one_form", *same).distinct()
    other = texts.select("k", *[F.col(c).alias(f"{c}_b") for c in ("value", "one_form", *same)])
    match = (F.col("value") < F.col("value_b")) & (F.col("one_form") == F.col("one_form_b"))
    for c in same:
        match &= F.col(c).eqNullSafe(F.col(f"{c}_b"))
    pairs = texts.join(other, "k").where(match).select("k", "value", "value_b", *same)
    on = ["k", "value", *same]
    ids = members.select("id", *[F.col(c).alias(f"m_{c}") for c in on])
    a = pairs.join(ids, [pairs[c].eqNullSafe(ids[f"m_{c}"]) if c in same else pairs[c] == ids[f"m_{c}"] for c in on]).select("k", "value_b", *same, F.col("id").alias("a"))
    b = a.join(ids, [a[c].eqNullSafe(ids[f"m_{c}"]) if c in same else a["value_b" if c == "value" else c] == ids[f"m_{c}"] for c in on]).select("a", F.col("id").alias("b"))
    return b.where("a <> b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
