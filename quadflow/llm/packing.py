"""Filling containers of fixed capacity: Karmarkar-Karp multiway differencing within bounded shards."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Part of a window that may stay empty when it is closed before the last turn, and by how much it grows per turn.
SLACK, GROWTH = 0.01, 1.3
#: Shards that a task packs, one after the other, and tasks at most.
SHARDS_A_TASK, TASKS = 4, 50_000
#: Items per shard, on average: bounds a task's memory and time; a shard wastes less than one container.
SHARD = 2048


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each item, sum of each window) for k windows of near-equal sums.

    A partial partition is the descending array of its non-empty windows. The two with the largest differences merge,
    the largest windows of one upon the smallest of the other. Windows are trees over the items until the end.
    """
    n = len(sizes)
    left, right = np.full(2 * n, -1, np.int64), np.full(2 * n, -1, np.int64)
    used = n
    order = np.argsort(-sizes, kind="stable")
    heap = [(-int(sizes[i]) if k > 1 else 0, int(r), np.array([sizes[i]]), np.array([i])) for r, i in enumerate(order)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        over = len(a) + len(b) - k  # windows in which both have items
        if over > 0:
            pairs = np.arange(used, used + over)
            left[pairs], right[pairs] = an[len(a) - over :], bn[len(b) - over :][::-1]
            used += over
            s = np.concatenate([a[: len(a) - over], b[: len(b) - over], a[len(a) - over :] + b[len(b) - over :][::-1]])
            nodes = np.concatenate([an[: len(a) - over], bn[: len(b) - over], pairs])
        else:
            s, nodes = np.concatenate([a, b]), np.concatenate([an, bn])
        by = np.argsort(-s, kind="stable")
        s, nodes = s[by], nodes[by]
        heapq.heappush(heap, (-int(s[0] - (s[-1] if len(s) == k else 0)), tick, s, nodes))
        tick += 1
    _, _, s, nodes = heap[0]
    window = np.full(2 * n, -1, np.int64)
    window[nodes] = np.arange(len(nodes))
    for node in range(used - 1, n - 1, -1):  # parents have larger numbers than children
        window[left[node]] = window[right[node]] = window[node]
    return window[:n], s


def pack_shard(sizes: np.ndarray, capacity: int, slack: float = SLACK, growth: float = GROWTH) -> tuple[np.ndarray, int]:
    """(window of each item, number of windows); no item may exceed the capacity.

    The number of windows starts at what the total needs. Where differencing leaves windows above capacity, those within
    it and full but for slack are closed, and the items of all others are differenced again over as many windows as
    their total needs, which is more than they had; if none could be closed, one more. slack grows from turn to turn, so
    that every window is closed in the end, at the latest with an item each.
    """
    window, used, left, more = np.full(len(sizes), -1, np.int64), 0, np.arange(len(sizes)), 0
    while len(left):
        x = sizes[left]
        k = min(len(x), max(1, -(-int(x.sum()) // capacity), int((x * 2 > capacity).sum())) + more)
        at, _ = differencing(x, k)
        sums = np.bincount(at, weights=x, minlength=k)
        closed = sums <= capacity if (sums <= capacity).all() else (sums <= capacity) & (sums >= capacity * (1 - slack))
        number = np.full(k, -1, np.int64)
        number[closed] = np.arange(used, used + int(closed.sum()))
        window[left] = number[at]
        used, left, more, slack = used + int(closed.sum()), left[~closed[at]], more + (not closed.any()), slack * growth
    return window, used


def pack(items: DataFrame, limits: list[tuple[str, int]], shard: int = SHARD) -> DataFrame:
    """(profile, window, item_id, start, size): for each profile every item in one window of at most its capacity.

    items: (item_id, size) with size in tokens; a null size counts as 0, a null item_id is an item too, repeated rows
    are items of their own. limits: (profile, capacity), capacity at least 1. An item above the capacity fills windows
    of its own and its rest is packed like an item; start is where a piece begins in its item. Items of size 0 take no
    space but have a window. No items: no windows.

    Items are dealt to shards by hash, repeated ones by their number too, so a shard holds about shard items whatever
    the data; shards are packed in parallel and no task sees more than one.
    """
    counted = items.select("item_id", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")).groupBy("item_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    profiles = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(int(c)).cast("bigint").alias("capacity")) for p, c in limits])
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("item_id", "size", "copy", F.explode(profiles).alias("p")).select("item_id", "size", "copy", "p.profile", "p.capacity")
    whole = F.floor(F.col("size") / F.col("capacity")).cast("bigint")
    whole = F.when(F.col("size") % F.col("capacity") == 0, F.greatest(whole - 1, F.lit(0).cast("bigint"))).otherwise(whole)
    each = each.withColumn("whole", whole)
    full = each.where("whole > 0").withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1))).select(
        "profile", F.concat_ws("-", F.lit("own"), F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "copy", "size", "at").alias("window"),
        "item_id", (F.col("at") * F.col("capacity")).alias("start"), F.col("capacity").alias("size"),
    )
    shards = max(1, -(-items.count() // shard))
    rest = each.select("profile", "capacity", "item_id", (F.col("whole") * F.col("capacity")).alias("start"), (F.col("size") - F.col("whole") * F.col("capacity")).alias("size"), F.pmod(F.xxhash64("item_id", "copy", "size"), F.lit(shards)).alias("shard"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item_id", "start"], ascending=False, kind="stable")
        window, _ = pack_shard(pdf["size"].to_numpy(), int(pdf["capacity"].iloc[0]))
        return pd.DataFrame({"profile": key[0], "window": [f"{key[1]}-{w}" for w in window], "item_id": pdf["item_id"], "start": pdf["start"], "size": pdf["size"]})

    # as many tasks as the shards need: by bytes alone, thousands of shards would fit one
    tasks = max(1, min(TASKS, -(-shards * len(limits) // SHARDS_A_TASK)))
    packed = rest.repartition(tasks, "profile", "shard").groupBy("profile", "shard").applyInPandas(one, full.schema)
    return packed.unionByName(full)


def fill(packed: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """(profile, n_windows, n_pieces, used, unused_share) of pack()."""
    capacity = F.coalesce(*[F.when(F.col("profile") == p, F.lit(int(c))) for p, c in limits])
    windows = packed.groupBy("profile", "window").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("n"))
    return windows.groupBy("profile").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n_pieces"), F.sum("used").alias("used")).withColumn("unused_share", 1 - F.col("used") / (F.col("n_windows") * capacity))
