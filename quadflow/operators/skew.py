"""Per-key results where a few keys hold most rows: range partitions on key and order, stitched at their boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadflow.runtime import parts

PARTIAL = "part int, field_name string, key_id bigint, n bigint, first_us bigint, last_us bigint, max_gap_us bigint"


def key_rows(rows: DataFrame, fields: list[str], order: str, tie: str) -> DataFrame:
    """(field_name, key_id, us, tie): one row per row and field; us is the order column in microseconds."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("bigint").alias("key_id")) for f in fields])
    return rows.select(F.explode(pairs).alias("x"), F.unix_micros(order).alias("us"), F.col(tie).alias("tie")).select("x.field_name", "x.key_id", "us", "tie")


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of each run of equal keys of one sorted partition; the last run of a batch is carried into the next."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    carry: list | None = None  # field, key, n, first, last, gap

    def batch(cols: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), part), pa.int32()), *cols], names=["part", "field_name", "key_id", "n", "first_us", "last_us", "max_gap_us"])

    def one(run: list) -> pa.RecordBatch:
        return batch([pa.array([run[0]], pa.string()), *[pa.array([x], pa.int64()) for x in run[1:]]])

    for b in batches:
        if not b.num_rows:
            continue
        names = b.column(0).dictionary_encode()
        codes, keys, us = names.indices.fill_null(-1).to_numpy(zero_copy_only=False), b.column(1), b.column(2)
        known, k = ~np.asarray(keys.is_null()), keys.fill_null(0).to_numpy(zero_copy_only=False)
        timed, t = ~np.asarray(us.is_null()), us.fill_null(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (k[1:] != k[:-1]) | (known[1:] != known[:-1])])
        gaps = np.r_[-1, np.where(timed[1:] & timed[:-1], t[1:] - t[:-1], -1)]
        gaps[starts] = -1
        n, dated = np.diff(np.r_[starts, b.num_rows]), np.add.reduceat(timed.astype(np.int64), starts) > 0
        first = np.minimum.reduceat(np.where(timed, t, np.iinfo(np.int64).max), starts)
        last = np.maximum.reduceat(np.where(timed, t, np.iinfo(np.int64).min), starts)
        gap = np.maximum.reduceat(gaps, starts)

        def run(i: int) -> list:
            at = starts[i]
            times = (int(first[i]), int(last[i])) if dated[i] else (None, None)  # noqa: B023
            return [names.dictionary[int(codes[at])].as_py() if codes[at] >= 0 else None, int(k[at]) if known[at] else None, int(n[i]), *times, int(gap[i]) if gap[i] >= 0 else None]  # noqa: B023

        head = run(0)
        if carry and carry[:2] == head[:2]:
            between = head[3] - carry[4] if head[3] is not None and carry[4] is not None else None
            head = [*head[:2], carry[2] + head[2], carry[3] if carry[3] is not None else head[3], head[4] if head[4] is not None else carry[4], max((g for g in (carry[5], head[5], between) if g is not None), default=None)]
        elif carry:
            yield one(carry)
        if len(starts) == 1:
            carry = head
            continue
        yield one(head)
        if len(starts) > 2:
            at, mid = starts[1:-1], slice(1, -1)
            fields = names.dictionary.take(pa.array(np.where(codes[at] >= 0, codes[at], 0), mask=codes[at] < 0))
            yield batch([fields.cast(pa.string()), pa.array(k[at], pa.int64(), mask=~known[at]), pa.array(n[mid], pa.int64()), pa.array(first[mid], pa.int64(), mask=~dated[mid]), pa.array(last[mid], pa.int64(), mask=~dated[mid]), pa.array(gap[mid], pa.int64(), mask=gap[mid] < 0)])
        carry = run(len(starts) - 1)
    if carry:
        yield one(carry)


def key_partials(keyed: DataFrame, n: int | None = None) -> DataFrame:
    """The partial state per partition and key, over range partitions by key, order and tie.

    Sampled quantiles of the whole composite key bound the partitions, so a key with a third of all rows gets a third
    of the partitions and a partition holds about as many rows as any other.
    """
    spread = keyed.repartitionByRange(n or parts(keyed.sparkSession), "field_name", "key_id", "us", "tie").sortWithinPartitions("field_name", "key_id", "us", "tie")
    return spread.select("field_name", "key_id", "us").mapInArrow(_partials, PARTIAL)


def key_stats(keyed: DataFrame, n: int | None = None) -> DataFrame:
    """(field_name, key_id, n_rows, first_us, last_us, max_gap_us) per key, from key_rows().

    max_gap_us is the longest time between neighbours in time order, null for fewer than two timed rows. Rows without a
    time count in n_rows only. A null key is a key of its own. Ties and repeated rows count each. No rows: no keys.
    A key that lies in several partitions is stitched: its partials, at most one per partition, in partition order, with
    the gaps between the last row of one and the first of the next.
    """
    state = key_partials(keyed, n)
    before = Window.partitionBy("field_name", "key_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    joined = state.withColumn("gap", F.col("first_us") - F.max("last_us").over(before))
    return joined.groupBy("field_name", "key_id").agg(F.sum("n").alias("n_rows"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.max(F.greatest("max_gap_us", "gap")).alias("max_gap_us"))


def heavy_keys(stats: DataFrame, total: int, share: float = 0.05) -> DataFrame:
    """(field_name, key_id) of the keys with at least that share of total rows; a null key is no value."""
    return stats.where((F.col("key_id").isNotNull()) & (F.col("n_rows") >= share * F.lit(total)) & F.lit(total > 0)).select("field_name", "key_id")
