"""Frequency of every distinct term, by recursive radix spilling and DuckDB."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadflow.runtime import scratch, small

#: Hash bits per level, and so 2^BITS partitions of a partition.
BITS = 4
#: Bytes of a partition, text and numbers as they are in memory, above which it is split further.
LIMIT = 64 << 20
#: Levels at most: 64 hash bits.
LEVELS = 64 // BITS - 1
#: What DuckDB may use for one partition, several times as much as it holds.
DUCKDB_MEMORY = "512MB"

TERMS = "field_name string, term string, record bigint, n bigint"
PARTIAL = "field_name string, term string, occurrences bigint, records bigint"


def _digit(key: Column, level: int) -> Column:
    return F.shiftrightunsigned(key, BITS * level).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _partitions(spark: SparkSession, terms: DataFrame, limit: int) -> list[str]:
    """Folders that hold the rows, each with at most limit bytes as far as hashes can part them.

    Level 0 goes by the term's hash, so most terms are whole in one partition; below, by the hash of term and record, so
    one heavy term is split too while each (term, record) pair stays in one place and distinct records add up. A level
    is one partitioned write of all partitions that are too large, without an exchange, and one job that sums up sizes;
    the driver sees one row per partition.
    """
    done: list[str] = []
    rows, where = terms, F.lit("")
    for level in range(LEVELS + 1):
        key = F.xxhash64("field_name", "term") if level == 0 else F.xxhash64("field_name", "term", "record")
        at = scratch(spark, f"radix{level}")
        rows.withColumn("radix", F.concat(where, F.format_string("%02d", _digit(key, level)))).write.partitionBy("radix").parquet(at)
        sizes = spark.read.schema(TERMS + ", radix string").parquet(at).groupBy("radix").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term") + F.octet_length("field_name") + 16).alias("bytes"))
        large = []
        for r in sizes.collect():  # a row per partition
            split = r["bytes"] > limit and r["n"] > 1 and level < LEVELS
            (large if split else done).append(f"{at}/radix={r['radix']}")
        if not large:
            break
        rows, where = spark.read.schema(TERMS + ", radix string").option("basePath", at).parquet(*large), F.concat("radix", F.lit("-"))
    return done


def _aggregate(folders: list[str], spill: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import pyarrow.dataset as ds
        from pyarrow import fs

        for b in batches:
            for i in b.column(0).to_pylist():
                files, path = fs.FileSystem.from_uri(folders[i].replace("file:/", "file:///", 1) if not folders[i].startswith("file://") else folders[i])
                # spilled into the shared folder where that is a path, else nowhere: a partition fits by its limit of bytes
                local = spill.startswith("file:")
                config = {"threads": 1, "memory_limit": DUCKDB_MEMORY, "preserve_insertion_order": False, "temp_directory": f"/{spill[5:].lstrip('/')}/{i}" if local else ""}
                with duckdb.connect(config=config) as con:
                    con.register("spilled", ds.dataset(path, filesystem=files, format="parquet"))
                    out = con.sql("select field_name, term, cast(sum(n) as bigint) as occurrences, count(*) as records from spilled group by all")
                    yield from out.to_arrow_reader(100_000)

    return run


def term_frequencies(terms: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(field_name, term, occurrences, records) of every distinct term of a field.

    terms: (field_name, term, record, n), n occurrences in one part of the record; several rows per term and record add
    up. A null term or record is left out; an empty term is a term. Further columns are ignored. No rows: no terms.
    The rows of a term and record are summed up before anything is written, so no pair however frequent weighs more than
    another. A partition is read by one task, which streams its files through DuckDB with a fixed memory limit and a
    spill folder in the shared folder. A term split over several partitions is summed up at the end.
    """
    spark = terms.sparkSession
    kept = terms.where("term is not null and record is not null and n > 0").select(F.coalesce("field_name", F.lit("")).alias("field_name"), "term", F.col("record").cast("bigint").alias("record"), F.col("n").cast("bigint").alias("n"))
    folders = _partitions(spark, kept.groupBy("field_name", "term", "record").agg(F.sum("n").alias("n")), limit)
    if not folders:
        return spark.createDataFrame([], PARTIAL)
    partials = spark.range(0, len(folders), 1, len(folders)).mapInArrow(_aggregate(folders, scratch(spark, "duckdb")), PARTIAL)
    return partials.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(frequencies: DataFrame, totals: DataFrame, rare: int = 3, common: float = 0.5) -> DataFrame:
    """frequencies with total (records of the field) and mark: "rare" for at most so many records, "common" for at least
    that share of all records (which wins if both hold), else null. totals: (field_name, total)."""
    with_total = frequencies.join(small(totals), "field_name")
    return with_total.withColumn("mark", F.when(F.col("records") >= common * F.col("total"), "common").when(F.col("records") <= rare, "rare"))


def value_terms(rows: DataFrame, field: str, record: str, text: str, pattern: str = "([A-Za-z]+)") -> DataFrame:
    """(field_name, term, record, n) of the matches in each record's texts, lower-cased; a re-delivered row (same record
    and text) counts once."""
    once = rows.where(F.col(record).isNotNull() & F.col(text).isNotNull()).select(F.col(record).alias("record"), F.col(text).alias("text")).distinct()
    words = once.select("record", F.explode(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.lower)).alias("term"))
    return words.select(F.lit(field).alias("field_name"), "term", F.col("record").cast("bigint").alias("record"), F.lit(1).cast("bigint").alias("n"))
