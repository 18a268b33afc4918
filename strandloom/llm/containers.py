"""Filling containers of fixed capacity with items of varying size, item by item, with few bins open at a time.

Bounded-space online best fit. A bitset has one bit for every amount of free space that an open bin has; the lowest bit at
or above an item's size names the bin that fits it best. If none fits and the allowed number of bins is open, the
fullest is closed. Items are dealt to shards by a hash of their id and packed there in the order of id, so the result
does not depend on how the input lies in files or on which executor runs a task, and each shard needs memory for its
open bins only. Shards hold many containers each: their last, open bins are the only space lost by packing apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class BestFit:
    """Open bins by free space; put() gives the number of the bin that takes an item."""

    def __init__(self, capacity: int, open_bins: int = 64) -> None:
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and number of open bins must be positive")
        self.capacity, self.most = capacity, open_bins
        self.free_bits, self.by_free, self.open, self.made = 0, {}, 0, 0

    def _open(self, free: int, bin_: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(bin_)
            self.free_bits |= 1 << free
            self.open += 1

    def _taken(self, free: int) -> int:
        bins = self.by_free[free]
        bin_ = bins.pop()
        if not bins:
            del self.by_free[free]
            self.free_bits ^= 1 << free
        self.open -= 1
        return bin_

    def put(self, size: int) -> int:
        """The bin of an item of at most the capacity; items of size 0 go where the least space is left."""
        fitting = self.free_bits >> size << size
        if fitting:
            free = (fitting & -fitting).bit_length() - 1
            bin_ = self._taken(free)
            self._open(free - size, bin_)
            return bin_
        if self.open >= self.most:  # the fullest closes first
            self._taken((self.free_bits & -self.free_bits).bit_length() - 1)
        bin_, self.made = self.made, self.made + 1
        self._open(self.capacity - size, bin_)
        return bin_

    def place(self, size: int) -> list[tuple[int, int, int]]:
        """(bin, start, length) of the parts of an item: one, unless it is larger than the capacity, which alone is divided;
        its full parts fill bins of their own."""
        parts, start = [], 0
        while size - start > self.capacity:
            parts.append((self.made, start, self.capacity))
            self.made += 1
            start += self.capacity
        return [*parts, (self.put(size - start), start, size - start)]


def fill(sizes: DataFrame, limits: DataFrame, open_bins: int = 64, per_shard: int = 4_000_000) -> DataFrame:
    """(limit_id, id, part, container, start, length): the container of every item for every limit.

    sizes (id, size): null sizes count as 0. limits (limit_id, capacity), few rows; null or non-positive capacities
    are left out. Container numbers are unique within a limit_id. per_shard: total size that a shard packs, on average,
    every item counting 16 more, so that many small or empty items are spread too.
    """
    wanted = [(r["limit_id"], r["capacity"]) for r in limits.filter("capacity > 0").orderBy("limit_id").collect()]
    schema = "limit_id int, id long, part int, container long, start long, length long"
    items = sizes.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    if not wanted:
        return items.sparkSession.createDataFrame([], schema)
    total = items.agg(F.sum(F.col("size") + 16)).first()[0] or 0
    shards = max(1, int(total // per_shard))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        order = np.lexsort((table.column("size").to_numpy(), table.column("id").to_numpy()))
        ids, size = table.column("id").to_numpy()[order], table.column("size").to_numpy()[order].tolist()
        out: list[pa.Table] = []
        for limit, capacity in wanted:
            bins = BestFit(capacity, open_bins)
            parts = [bins.place(n) for n in size]
            counts = np.array([len(p) for p in parts])
            flat = np.array([x for p in parts for x in p], np.int64).reshape(-1, 3)
            nth = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
            out.append(pa.table({
                "limit_id": pa.array(np.full(len(flat), limit), pa.int32()), "id": np.repeat(ids, counts), "part": pa.array(nth, pa.int32()),
                "container": flat[:, 0] * shards + shard, "start": flat[:, 1], "length": flat[:, 2],
            }))
        return pa.concat_tables(out)

    dealt = items.withColumn("shard", F.pmod(F.xxhash64(F.coalesce("id", F.lit(-1))), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(pack, schema)


def usage(placed: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, containers, used, capacity, unused_share) of what fill() gave."""
    bins = placed.groupBy("limit_id", "container").agg(F.sum("length").alias("used"))
    each = bins.groupBy("limit_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("used"))
    out = each.join(F.broadcast(limits.select("limit_id", "capacity")), "limit_id")
    return out.withColumn("unused_share", 1 - F.col("used") / (F.col("containers") * F.col("capacity")))
