"""Clusters by reciprocal nearest neighbours on a sparse graph of similarities.

In every round each cluster points at its most similar neighbour (of equals, the least id). Pairs that point at each
other are merged, all in parallel, until no similarity reaches the threshold. With average linkage, pairs of
records without an edge count as similarity 0. With single linkage the order of merges doesn't matter, so every
cluster may follow its pointer at once: the pointers form trees whose roots are the reciprocal pairs, and a round
merges whole trees instead of one pair each; a hub with very many neighbours takes one round.

Rounds are joins and aggregations over the whole cluster as long as more than LOCAL edges are left. The last rounds, the
same ones, run within one task, which then holds at most LOCAL edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.plans.shared import keep

#: Edges that a single task may hold, about 100 MB.
LOCAL = 1_000_000


def _nearest(edges: DataFrame, strength: F.Column) -> DataFrame:
    """(u, to): the strongest neighbour of each cluster, of equals the least."""
    s = edges.select("a", "b", strength.alias("s"))
    both = s.select(F.col("a").alias("u"), F.col("b").alias("v"), "s").unionAll(s.select(F.col("b").alias("u"), F.col("a").alias("v"), "s"))
    return both.groupBy("u").agg(F.max_by("v", F.struct("s", -F.col("v"))).alias("to"))


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between renamed clusters, lower id first; names (u, root) of all clusters that change."""
    x, y = names.select(F.col("u").alias("a"), F.col("root").alias("ra")), names.select(F.col("u").alias("b"), F.col("root").alias("rb"))
    wide = edges.join(x, "a", "left").join(y, "b", "left")
    a, b = F.coalesce("ra", "a"), F.coalesce("rb", "b")
    return wide.withColumns({"p": F.least(a, b), "q": F.greatest(a, b)}).filter("p < q").drop("a", "b", "ra", "rb").withColumnsRenamed({"p": "a", "q": "b"})


def _joined(members: DataFrame | None, names: DataFrame) -> DataFrame:
    """(id, cluster) after a round."""
    if members is None:
        return names.select(F.col("u").alias("id"), F.col("root").alias("cluster"))
    new = names.select(F.col("u").alias("cluster"), "root")
    return members.join(new, "cluster", "left").select("id", F.coalesce("root", "cluster").alias("cluster"))


def rounds(a: np.ndarray, b: np.ndarray, weight: np.ndarray, sizes: np.ndarray, threshold: float | None) -> np.ndarray:
    """The cluster of each of len(sizes) clusters after all rounds on edges a < b between their numbers.

    Without a threshold single linkage, weight being the similarity; else average linkage, weight being the sum of the
    similarities of all pairs of records.
    """
    cluster, sizes = np.arange(len(sizes)), sizes.astype(float).copy()
    while len(a):
        s = weight if threshold is None else weight / (sizes[a] * sizes[b])
        u, v, s2 = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
        order = np.lexsort((v, -s2, u))
        first = order[np.flatnonzero(np.append(True, np.diff(u[order]) != 0))]
        to = np.arange(len(sizes))
        to[u[first]] = v[first]
        mutual = to[to] == np.arange(len(sizes))
        if threshold is None:
            root = np.where(mutual, np.minimum(to, np.arange(len(sizes))), to)
            while True:
                further = root[root]
                if (further == root).all():
                    break
                root = further
        else:
            best = np.full(len(sizes), -np.inf)
            best[u[first]] = s2[first]
            merged = mutual & (to != np.arange(len(sizes))) & (best >= threshold - 1e-12)
            if not merged.any():
                break
            root = np.where(merged, np.minimum(to, np.arange(len(sizes))), np.arange(len(sizes)))
            sizes = np.bincount(root, sizes, minlength=len(sizes))
        cluster = root[cluster]
        x, y = root[a], root[b]
        kept = x != y
        x, y, weight = np.minimum(x, y)[kept], np.maximum(x, y)[kept], weight[kept]
        order = np.lexsort((y, x))
        x, y, weight = x[order], y[order], weight[order]
        fresh = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.empty(0, np.int64)
        a, b = x[fresh], y[fresh]
        weight = (np.maximum if threshold is None else np.add).reduceat(weight, fresh) if len(fresh) else weight
    return cluster


def _last_rounds(edges: DataFrame, threshold: float | None) -> DataFrame:
    """(u, root) of all clusters with an edge; edges (a, b, w, na, nb), at most LOCAL."""
    def run(table: pa.Table) -> pa.Table:
        a, b, w, na, nb = (table.column(c).to_numpy() for c in ("a", "b", "w", "na", "nb"))
        names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        sizes = np.zeros(len(names))
        sizes[place] = np.concatenate([na, nb])
        x, y = place[: len(a)], place[len(a) :]
        root = rounds(np.minimum(x, y), np.maximum(x, y), w, sizes, threshold)
        return pa.table({"u": names, "root": names[root]})

    return edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "u long, root long")


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(id, cluster) of every record with an edge (a, b, similarity): single linkage, cluster is its least id."""
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long"), "similarity")
    members = None
    while True:
        if edges.count() <= LOCAL:
            one = F.lit(1).alias("na"), F.lit(1).alias("nb")
            names = _last_rounds(edges.select("a", "b", F.col("similarity").alias("w"), *one), None)
            members = keep(_joined(members, names), "members")
            break
        to = _nearest(edges, F.col("similarity"))
        back = to.select(F.col("u").alias("to"), F.col("to").alias("next"))
        # a reciprocal pair is a root: its lower cluster points at itself
        step = to.join(back, "to", "left").select("u", F.when((F.col("next") == F.col("u")) & (F.col("u") < F.col("to")), F.col("u")).otherwise(F.col("to")).alias("root"))
        step = keep(step, "step")
        for _ in range(jumps):
            far = step.select(F.col("u").alias("root"), F.col("root").alias("far"))
            step = step.join(far, "root").select("u", F.col("far").alias("root"))
        step = keep(step, "step")
        members = keep(_joined(members, step), "members")
        edges = keep(_renamed(edges, step).groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "edges")
    least = members.groupBy("cluster").agg(F.min("id").alias("least"))
    return members.join(least, "cluster").select("id", F.col("least").alias("cluster"))


def average_linkage(edges: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """(id, cluster) of every record in weights (id, weight): average linkage down to threshold.

    edges (a, b, similarity), each pair once. weight is the number of equal records that an id stands for. The cluster
    of a record is the least id in it. Rounds end when no reciprocal pair reaches the threshold.
    """
    e = edges.join(weights.select(F.col("id").alias("a"), F.col("weight").alias("na")), "a").join(weights.select(F.col("id").alias("b"), F.col("weight").alias("nb")), "b")
    e = keep(e.select("a", "b", "na", "nb", (F.col("similarity") * F.col("na") * F.col("nb")).alias("total")), "edges")
    members = None
    mean = F.col("total") / (F.col("na") * F.col("nb"))
    while True:
        if e.count() <= LOCAL:
            names = keep(_last_rounds(e.select("a", "b", F.col("total").alias("w"), "na", "nb"), threshold).filter("u <> root"), "names")
            roots = names.select(F.col("root").alias("u"), "root").distinct()
            members = _joined_all(members, names.unionByName(roots))
            break
        to = _nearest(e, mean)
        back = to.select(F.col("u").alias("to"), F.col("to").alias("next"))
        pairs = to.join(back, "to").filter("next = u and u < to").select(F.col("u").alias("a"), F.col("to").alias("b"))
        merged = keep(e.join(pairs, ["a", "b"]).filter(mean >= threshold - 1e-12).select("a", "b", "na", "nb"), "merged")
        if merged.isEmpty():
            break
        names = merged.select(F.col("a").alias("u"), F.col("a").alias("root"), (F.col("na") + F.col("nb")).alias("n")).unionAll(merged.select(F.col("b").alias("u"), F.col("a").alias("root"), (F.col("na") + F.col("nb")).alias("n")))
        members = keep(_joined_all(members, names), "members")
        x = names.select(F.col("u").alias("a"), F.col("root").alias("ra"), F.col("n").alias("ma"))
        y = names.select(F.col("u").alias("b"), F.col("root").alias("rb"), F.col("n").alias("mb"))
        wide = e.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ra", "a").alias("p"), F.coalesce("ma", "na").alias("np"), F.coalesce("rb", "b").alias("q"), F.coalesce("mb", "nb").alias("nq"), "total").filter("p <> q")
        turned = wide.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.when(F.col("p") < F.col("q"), F.col("np")).otherwise(F.col("nq")).alias("na"), F.when(F.col("p") < F.col("q"), F.col("nq")).otherwise(F.col("np")).alias("nb"), "total")
        e = keep(turned.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("total").alias("total")), "edges")
    if members is None:
        return weights.select("id", F.col("id").alias("cluster"))
    return weights.select("id").join(members, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def _joined_all(members: DataFrame | None, names: DataFrame) -> DataFrame:
    """As _joined(), where records may enter in a later round: whoever is renamed under its own id is new."""
    first = names.select(F.col("u").alias("id"), F.col("root").alias("cluster"))
    if members is None:
        return first
    new = names.select(F.col("u").alias("cluster"), "root")
    moved = members.join(new, "cluster", "left").select("id", F.coalesce("root", "cluster").alias("cluster"))
    return moved.unionByName(first.join(members.select("id"), "id", "left_anti"))
