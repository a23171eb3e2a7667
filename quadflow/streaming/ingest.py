"""Statements that keep arriving: a folder of N-Triples files as a stream of quads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadflow.runtime import scratch
from quadflow.sources.readers import lines_as_quads


def stream_quads(spark: SparkSession, folder: str, graph: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Quads of files as they come; the parsing is the batch reader's and stays in the JVM."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return lines_as_quads(reader.load(folder), graph).quads


def stream_into(quads: DataFrame, path: str, checkpoint: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Appends a stream of quads to a Parquet table, exactly once. The checkpoint belongs in a folder that outlives the
    driver; without one it is put into the cluster's shared folder."""
    writer = quads.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint or scratch(quads.sparkSession, "stream"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counts_by_predicate(quads: DataFrame, at: str, watermark: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Statements per predicate and time window of a stream with a time column; rows later than the watermark are left out."""
    return quads.withWatermark(at, watermark).groupBy(F.window(at, window), "p").agg(F.count(F.lit(1)).alias("n"))
