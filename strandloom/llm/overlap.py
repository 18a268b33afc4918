"""Records of an evaluation split that recur, exactly or almost, in the training split.

Winnowing fingerprints: of every w neighbouring seeds of k letters the one with the least rolling hash is kept, on both
sides, and equal ones are joined across the splits. Pairs found so are verified on their whole letters; then their
common seeds are chained in order, the chain is extended by alignment, and the letters it covers are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import letters as L
from strandloom.llm import simjoin as J
from strandloom.llm.thresholds import weigher
from strandloom.plans.shared import keep

RULE = J.Rule(0.5)


def _seeds(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    value, good = L.rolling(codes, k)
    return value[good], np.flatnonzero(good)


def diagonals(left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in left, start in right, length) of the maximal exact matches of at least k letters."""
    vl, pl = _seeds(left, k)
    vr, pr = _seeds(right, k)
    order = np.argsort(vl, kind="stable")
    lo, hi = np.searchsorted(vl[order], vr, "left"), np.searchsorted(vl[order], vr, "right")
    n = hi - lo
    j = np.repeat(pr, n)
    i = pl[order[np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]]
    by = np.lexsort((j, i - j))
    i, j = i[by], j[by]
    if not len(i):
        return i, j, i
    starts = np.flatnonzero(np.append(True, (i[1:] - j[1:] != i[:-1] - j[:-1]) | (j[1:] != j[:-1] + 1)))
    return i[starts], j[starts], np.diff(np.append(starts, len(i))) + k - 1


def chained(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which matches form the collinear chain of most letters, in order; overlaps are cut from the later match."""
    order = np.lexsort((j, i))
    i, j, n = i[order], j[order], n[order]
    score, before = n.astype(np.int64).copy(), np.full(len(n), -1)
    for x in range(1, len(n)):
        overlap = np.maximum(0, np.maximum(i[:x] + n[:x] - i[x], j[:x] + n[:x] - j[x]))
        gain = np.where((i[:x] < i[x]) & (j[:x] < j[x]) & (overlap < n[x]), score[:x] + n[x] - overlap, 0)
        best = int(gain.argmax())
        if gain[best] > score[x]:
            score[x], before[x] = gain[best], best
    chain, x = [], int(score.argmax()) if len(n) else -1
    while x >= 0:
        chain.append(order[x])
        x = before[x]
    return np.array(chain[::-1], np.int64)


def _extended(left: np.ndarray, right: np.ndarray, drop: int = 6) -> int:
    """How far an alignment without gaps goes on: 1 for an equal letter, -2 for another, until drop below its best."""
    m = min(len(left), len(right))
    if not m:
        return 0
    score = np.cumsum(np.where((left[:m] == right[:m]) & (left[:m] < 4), 1, -2))
    high = np.maximum(np.maximum.accumulate(score), 0)
    over = np.flatnonzero(score < high - drop)
    score = score[: over[0]] if len(over) else score
    return int(score.argmax()) + 1 if len(score) and score.max() > 0 else 0


def coverage(left: np.ndarray, right: np.ndarray, k: int) -> tuple[int, int, int, int]:
    """(first, last, covered, pieces): the part of right, places from 1, that the aligned chain spans, how many of its
    letters the alignment covers, and the number of exact matches in the chain. Zeros if nothing matches."""
    i, j, n = diagonals(left, right, k)
    if not len(i):
        return 0, 0, 0, 0
    chain = chained(i, j, n)
    covered = np.zeros(len(right), bool)
    end_i = end_j = 0
    for x, c in enumerate(chain):
        a, b, m = int(i[c]), int(j[c]), int(n[c])
        back = _extended(left[end_i:a][::-1], right[end_j:b][::-1]) if a > end_i and b > end_j else 0
        nxt = chain[x + 1] if x + 1 < len(chain) else None
        stop_i, stop_j = (int(i[nxt]), int(j[nxt])) if nxt is not None else (len(left), len(right))
        on = _extended(left[a + m : stop_i], right[b + m : stop_j])
        covered[b - back : b + m + on] = True
        end_i, end_j = a + m + on, b + m + on
    places = np.flatnonzero(covered)
    return int(places[0]) + 1, int(places[-1]) + 1, len(places), len(chain)


def overlaps(train: DataFrame, test: DataFrame, id_col: str, text_col: str, rule: J.Rule = RULE) -> DataFrame:
    """(train_id, test_id, similarity, first, last, covered, pieces): all pairs of rows above the threshold.

    Copies are compared once and expanded at the end. Null ids or texts, and records with too few terms, are in no pair;
    an empty side gives no rows. Other columns of the tables are ignored.
    """
    rows = [J.rows(df, id_col, text_col, rule) for df in (train, test)]
    classes = [J.classes(r) for r in rows]
    both = classes[0].select("id", "letters", "floor").unionAll(classes[1].select("id", "letters", "floor"))
    letters = J.size_of(both)
    k, buckets = rule.seed_for(letters), J.buckets_for(letters)
    weigh = weigher(rule)(both, k, letters)
    blocks = J.seed_blocks(classes[0], rule, k, buckets, weigh, 0).unionAll(J.seed_blocks(classes[1], rule, k, buckets, weigh, 1))
    found = J.verified(J.proposed(blocks, rule, k, buckets, two_sides=True), classes[0], classes[1], rule)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = L.unpack(b.column(4)), L.unpack(b.column(5))
            got = [
                coverage(left.codes[s : s + n], right.codes[t : t + m], k)
                for s, n, t, m in zip(left.starts.tolist(), left.lengths.tolist(), right.starts.tolist(), right.lengths.tolist())
            ]
            more = [pa.array([g[c] for g in got], pa.int32()) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *more], ["a", "b", "common", "either", "first", "last", "covered", "pieces"])

    found = keep(found, "found")
    la, lb = classes[0].select(F.col("id").alias("a"), F.col("letters").alias("la")), classes[1].select(F.col("id").alias("b"), F.col("letters").alias("lb"))
    aligned = found.join(la, "a").join(lb, "b").select("a", "b", "common", "either", "la", "lb")
    aligned = aligned.mapInArrow(align, "a long, b long, common int, either int, first int, last int, covered int, pieces int")
    copies = [keep(J.copies_of(r, c), "copies") for r, c in zip(rows, classes)]
    x, y = copies[0].select(F.col("rep").alias("a"), F.col("id").alias("ia")), copies[1].select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    wide = aligned.join(x, "a", "left").join(y, "b", "left")
    return wide.select(F.coalesce("ia", "a").alias("train_id"), F.coalesce("ib", "b").alias("test_id"), (F.col("common") / F.col("either")).alias("similarity"), "first", "last", "covered", "pieces")


def report(pairs: DataFrame, train: DataFrame, test: DataFrame, id_col: str, source_col: str, split_col: str) -> DataFrame:
    """(split, source, pairs, test_rows, mean_covered): overlaps by evaluation split (spelling evened out) and source
    of the training row; test_rows counts each evaluation row once, mean_covered averages its best coverage there."""
    s = train.select(F.col(id_col).alias("train_id"), F.col(source_col).alias("source"))
    t = test.select(F.col(id_col).alias("test_id"), F.lower(F.trim(F.col(split_col))).alias("split"))
    each = pairs.join(s, "train_id").join(t, "test_id").groupBy("split", "source", "test_id").agg(F.count(F.lit(1)).alias("pairs"), F.max("covered").alias("covered"))
    return each.groupBy("split", "source").agg(F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("test_rows"), F.avg("covered").alias("mean_covered"))
