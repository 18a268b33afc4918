"""Unequal thresholds by the generalised pigeonhole principle.

The bits of a record are its stretches of ``stretch`` letters. Neighbouring stretches come and go together, so
they are grouped: a partition holds the stretches that chose the same seed. If two similar records have at least
M stretches in common, and partition i asks for e_i + 1 common ones with the sum of all e_i below M, then at least
one partition has what it asks for. A partition that asks for more than it holds proposes nothing. The e_i are
chosen for each record by dynamic programming, so that the pairs expected from all its partitions are fewest: the
counts of seeds over the whole collection tell which partitions are crowded (frequent motifs, adapters), and those
get the high thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandloom.llm import letters as L
from strandloom.llm.blocks import expand, squeeze
from strandloom.llm.simjoin import SKIP, Rule, Weigh, spending

#: The counts of seeds are kept in 2 ** CELLS cells, whatever the size of the collection: 4 MB in a broadcast.
CELLS = 22
_SLICES = 32


def crowding(table: DataFrame, rule: Rule, k: int) -> np.ndarray:
    """For each cell of seed hashes, the logarithm (base 2, rounded up) of its number of seeds in table, as uint8.

    Every task counts its own seeds; the counts are added up slice by slice in parallel, and only the finished
    4 MB reach the driver.
    """
    w, width = rule.stretch - k + 1, (1 << CELLS) // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELLS, np.uint32)
        for b in batches:
            _, seeds, _ = L.sampled(L.unpack(b.column(0)).codes, k, w, rule.term, rule.distinct)
            cells += np.bincount(cell(seeds), minlength=1 << CELLS).astype(np.uint32)
        blocks = [squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes()) for x in cells.reshape(_SLICES, width)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLICES), pa.int32()), pa.array(blocks, pa.binary())], ["slice", "block"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for block in group.column("block").to_pylist():
            total += np.ascontiguousarray(np.frombuffer(expand(block), np.uint8).reshape(4, width).T).view(np.uint32).reshape(-1)
        logs = np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pa.table({"slice": group.column("slice")[:1], "block": pa.array([squeeze(logs.tobytes())], pa.binary())})

    parts = table.select("letters").mapInArrow(count, "slice int, block binary").groupBy("slice").applyInArrow(add, "slice int, block binary")
    out = np.zeros((_SLICES, width), np.uint8)
    for row in parts.collect():  # _SLICES rows of 128 KB
        out[row["slice"]] = np.frombuffer(expand(bytes(row["block"])), np.uint8)
    return out.reshape(-1)


def cell(seeds: np.ndarray) -> np.ndarray:
    return (L.mixed(seeds) >> np.uint64(64 - CELLS)).astype(np.int64)


def allocate(sizes: np.ndarray, costs: np.ndarray, budgets: np.ndarray) -> np.ndarray:
    """Thresholds e of each partition, (records, partitions), with least expected cost and sum e <= budgets.

    A partition with e below its size costs its cost / 4 ** e (each further stretch in common is one more letter
    that must agree by chance), one with e equal to its size proposes nothing and costs nothing. Partitions of
    size 0 fill up the array.
    """
    n, m = sizes.shape
    budgets = np.minimum(budgets, sizes.sum(axis=1))
    top, most = int(budgets.max(initial=0)), int(sizes.max(initial=0))
    best = np.zeros((n, top + 1), np.float32)
    picks = np.zeros((m, n, top + 1), np.uint8)
    for j in range(m):
        now, pick = np.full_like(best, np.inf), picks[j]
        for e in range(min(most, top) + 1):
            cost = np.where(e < sizes[:, j], costs[:, j] / 4.0**e, 0).astype(np.float32)
            with_e = best[:, : top + 1 - e] + cost[:, None]
            better = with_e < now[:, e:]
            now[:, e:][better] = with_e[better]
            pick[:, e:][better] = e
        best = now
    left, out = budgets.astype(np.int64), np.zeros((n, m), np.int64)
    for j in reversed(range(m)):
        out[:, j] = picks[j, np.arange(n), left]
        left = left - out[:, j]
    return out


#: Places of one seed that go to one bucket, as a power of 2.
SHARE = 14


def weigher(rule: Rule, crowded: int = 6, most: int = 24):
    """For simjoin.links(): thresholds for the partitions whose cell has over 2 ** crowded seeds, 1 elsewhere; seeds whose
    cell has over 2 ** SHARE are spread over so many buckets that each gets about that.

    most: no record spends a larger budget than this.
    """
    share = SHARE

    def weigh_by(table: DataFrame, k: int, letters: int) -> Weigh:
        shared = table.sparkSession.sparkContext.broadcast(crowding(table, rule, k))
        budget_of = np.minimum(spending(rule)[0], most)

        def weigh(batch: L.Batch, which: np.ndarray, seeds: np.ndarray, chose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            need = np.ones(len(seeds), np.uint8)
            logs = shared.value[cell(seeds)]
            spread = np.int64(1) << np.maximum(logs.astype(np.int64) - share, 0)
            hot = np.flatnonzero((logs > crowded) & ~batch.broken()[which])  # none with N: what one breaks is not bounded (simjoin.rows)
            if not len(hot):
                return need, spread
            rows, row_of = np.unique(which[hot], return_inverse=True)
            nth = np.arange(len(hot)) - np.searchsorted(row_of, row_of)
            terms = np.bincount((L.distinct_terms(batch, rule.term) >> (2 * rule.term)).astype(np.int64), minlength=len(batch))[rows]
            budgets = budget_of[np.minimum(terms, len(budget_of) - 1)]
            size = np.bitwise_count(chose[hot])
            each = np.bincount(row_of)
            width = 1 << np.ceil(np.log2(each)).astype(np.int64)  # records with about as many crowded partitions together
            for m in np.unique(width).tolist():
                of_width = np.flatnonzero(width == m)
                for group in np.array_split(of_width, max(1, len(of_width) * m // 200_000)):
                    place = np.full(len(rows), -1)
                    place[group] = np.arange(len(group))
                    mine = place[row_of] >= 0
                    r, j = place[row_of[mine]], nth[mine]
                    sizes, costs = np.zeros((len(group), m), np.int64), np.zeros((len(group), m), np.float32)
                    sizes[r, j], costs[r, j] = size[mine], 2.0 ** logs[hot[mine]]
                    e = allocate(sizes, costs, budgets[group])[r, j]
                    need[hot[mine]] = np.where(e >= size[mine], SKIP, e + 1)
            return need, spread

        return weigh

    return weigh_by
