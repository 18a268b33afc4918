"""k-means (Lloyd), restarts, mini-batches, and spectral clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import kernels as K


def first_rows(df: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k different rows to start from: the first vectors in the order of md5('seed:id')."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    distinct = df.groupBy("x").agg(F.min(F.struct(order.alias("o"), "id")).alias("f"))
    return np.array([r["x"] for r in distinct.orderBy("f").limit(k).collect()], float)


def assign(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster (the nearest centroid, of equals the first) and d2, the squared distance to it."""
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d2 = K.squared_distances(K.matrix(b.column("x")), centroids) if b.num_rows else np.empty((0, len(centroids)))
            at = d2.argmin(1) if b.num_rows else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32()), pa.array(d2[np.arange(len(at)), at])], [*b.schema.names, "cluster", "d2"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(nearest, f"{kinds}, cluster int, d2 double")


def _step(df: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, float]:
    """New centroids and the distortion of the old ones; each task sends one row a cluster."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, distortion = np.zeros_like(centroids), np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
        for b in batches:
            if b.num_rows:
                x = K.matrix(b.column("x"))
                d2 = K.squared_distances(x, centroids)
                at = d2.argmin(1)
                np.add.at(total, at, x)
                n += np.bincount(at, minlength=len(n))
                distortion += np.bincount(at, d2[np.arange(len(at)), at], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(distortion)], ["cluster", "n", "total", "distortion"])

    parts = df.select("x").mapInArrow(sums, "cluster int, n long, total array<double>, distortion double")
    d = centroids.shape[1]
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(d)]).alias("total"), F.sum("distortion").alias("distortion"))
    new, distortion = centroids.copy(), 0.0
    for r in added.collect():  # one row a cluster
        distortion += r["distortion"]
        if r["n"]:  # an empty cluster keeps its centroid
            new[r["cluster"]] = np.array(r["total"]) / r["n"]
    return new, distortion


def kmeans(df: DataFrame, k: int, max_iter: int = 100, tol: float = 1e-30, seed: int = 0, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(centroids, distortion) for rows (id, x). Stops when the distortion changes by less than tol, or after max_iter steps."""
    centroids = first_rows(df, k, seed) if start is None else np.array(start, float)
    if not len(centroids):
        return centroids, 0.0
    before = np.inf
    for _ in range(max_iter):
        centroids, distortion = _step(df, centroids)
        if abs(before - distortion) < tol:
            break
        before = distortion
    return centroids, float(_step(df, centroids)[1])


def kmeans_best_of(df: DataFrame, k: int, runs: int, max_iter: int = 100) -> tuple[int, np.ndarray, float]:
    """(run, centroids, distortion) of the least distortion; of equals the first run."""
    best: tuple[int, np.ndarray, float] | None = None
    for run in range(runs):
        centroids, distortion = kmeans(df, k, max_iter, seed=run)
        if best is None or distortion < best[2]:
            best = run, centroids, distortion
    return best


def mini_batch_kmeans(df: DataFrame, k: int, batch: float = 0.1, steps: int = 5, seed: int = 0) -> np.ndarray:
    """Centroids from samples: each step moves them by a share of a sample of the rows, weighted by what they saw so far."""
    centroids = first_rows(df, k, seed)
    seen = np.zeros(len(centroids))
    for step in range(steps):
        part = assign(df.sample(batch, seed=seed * 1000 + step).select("id", "x"), centroids)
        rows = part.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("x")[i]) for i in range(centroids.shape[1])]).alias("x")).collect()
        for r in rows:
            c = r["cluster"]
            seen[c] += r["n"]
            centroids[c] += (r["n"] / seen[c]) * (np.array(r["x"]) - centroids[c])
    return centroids


def spectral(x: np.ndarray, clusters: int, sigma: float, size: int, compat: bool = False, max_iter: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(cluster of each row, means of the rows of each cluster) of k-mer vectors x with size letters.

    The Gram matrix size * exp(-|x - y|^2 / (2 sigma^2 size)) is decomposed, the rows of its leading eigenvectors
    normalised and grouped by k-means. compat takes the eigenvectors of the least eigenvalues instead. Rows must fit
    one process: pass distinct k-mers or anchors.
    """
    if len(x) > 10_000:
        raise ValueError("spectral clustering decomposes a matrix of all pairs: pass at most 10,000 rows")
    gram = size * np.exp(-K.squared_distances(x, x) / (2 * sigma**2 * size))
    values, vectors = np.linalg.eigh(gram)
    u = vectors[:, :clusters] if compat else vectors[:, ::-1][:, :clusters]
    u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    _, first = np.unique(u.round(12), axis=0, return_index=True)
    mu = u[np.sort(first)[:clusters]]
    for _ in range(max_iter):
        at = K.squared_distances(u, mu).argmin(1)
        mu = np.stack([u[at == c].mean(0) if (at == c).any() else mu[c] for c in range(len(mu))])
    at = K.squared_distances(u, mu).argmin(1)
    return at, np.stack([x[at == c].mean(0) for c in range(len(mu)) if (at == c).any()])
