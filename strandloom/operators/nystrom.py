"""Nystrom features of sequences from k-mer anchors (convolutional kernel networks), random and greedy anchors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import kernels as K
from strandloom.plans.shared import keep

#: Steps of greedy selection after which the state of all k-mers is written.
EVERY = 16

_CODES = np.zeros((256, 4))
for _i, _c in enumerate("ACGT"):
    _CODES[ord(_c), _i] = 1


def one_hot(kmers: list[str]) -> np.ndarray:
    """(n, 4k); letters other than A, C, G, T give zeros."""
    if not kmers:
        return np.empty((0, 0))
    return _CODES[np.frombuffer("".join(kmers).encode("latin-1", "replace"), np.uint8)].reshape(len(kmers), -1)


def windows(seq: str, k: int) -> np.ndarray:
    """One-hot k-mers at every position of a sequence, padded with zeros at both ends."""
    left, right = (k + 1) // 2 - 1, (k + 2) // 2 - 1
    flat = np.zeros((len(seq) + left + right, 4))
    flat[left : left + len(seq)] = _CODES[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    return np.lib.stride_tricks.sliding_window_view(flat.reshape(-1), 4 * k)[::4]


def gram(anchors: list[str], sigma: float, compat: bool = False) -> np.ndarray:
    """Kernel of all anchors. compat: the upper triangle with a halved diagonal."""
    z = one_hot(anchors)
    full = K.KmerCosine(sigma).block(z, z)
    return np.triu(full) - np.diag(np.diag(full)) / 2 if compat else full


def triangular_root(t: np.ndarray) -> np.ndarray:
    """Principal square root of an upper triangular matrix, diagonal by diagonal."""
    r, n = np.diag(np.sqrt(np.diag(t))), len(t)
    for d in range(1, n):
        for i in range(n - d):
            j = i + d
            r[i, j] = (t[i, j] - r[i, i + 1 : j] @ r[i + 1 : j, j]) / (r[i, i] + r[j, j])
    return r


def inverse_root(kernel: np.ndarray, beta: float = 1e-3, compat: bool = False) -> np.ndarray:
    """(K + beta I)^(-1/2); compat takes the triangular matrix as it is."""
    shifted = kernel + beta * np.eye(len(kernel))
    if compat:
        return np.linalg.inv(triangular_root(shifted))
    values, vectors = np.linalg.eigh(shifted)
    return (vectors / np.sqrt(np.maximum(values, 1e-15))) @ vectors.T


def embed(df: DataFrame, seq: str, anchors: list[str], sigma: float, beta: float = 1e-3, root: np.ndarray | None = None, compat: bool = False, anchor_norm: bool = False) -> DataFrame:
    """df without seq, with x: the mean kernel of all k-mers of a sequence with the anchors, times K_ZZ^(-1/2).

    The mean over positions comes first, then one product with the matrix: it is linear. Null and empty sequences give
    null. root: another matrix in place of K_ZZ^(-1/2). compat: anchors of norm 1 and the factor sqrt(k) for all k-mers.
    anchor_norm: the norm sqrt(k) for all k-mers, and the anchors' own, as for anchors that are centroids.
    """
    k = len(anchors[0])
    z = one_hot(anchors)
    nz = np.linalg.norm(z, axis=1)
    matrix = inverse_root(gram(anchors, sigma, compat), beta, compat) if root is None else root
    unit = z / np.maximum(nz, 1e-12)[:, None]
    shared = df.sparkSession.sparkContext.broadcast((unit, nz, matrix))  # p * 4k and p * p numbers, by the parameter p

    def means(texts: list[str]) -> np.ndarray:
        """Of each text, none empty, the mean over its places of the kernel with the anchors: one product for all of them."""
        unit, nz, _ = shared.value
        sizes = np.array([len(t) for t in texts])
        left, right = (k + 1) // 2 - 1, (k + 2) // 2 - 1
        flat = _CODES[np.frombuffer("".join(" " * left + t + " " * right for t in texts).encode("latin-1", "replace"), np.uint8)]
        first = np.cumsum(sizes + left + right) - (sizes + left + right)
        upto = np.cumsum(sizes)
        places = np.arange(upto[-1]) + np.repeat(first - (upto - sizes), sizes)
        w = np.lib.stride_tricks.sliding_window_view(flat.reshape(-1), 4 * k)[::4][places]
        n = np.sqrt(w.sum(1))
        n = np.full(len(n), np.sqrt(k)) if anchor_norm else n
        cosine = (w @ unit.T) / np.where(n > 0, n, 1)[:, None]
        e = np.exp((cosine - 1) / sigma**2)
        e = np.sqrt(k) * e if compat else n[:, None] * nz * e
        return np.add.reduceat(e, upto - sizes) / sizes[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value[2]
        for b in batches:
            texts = b.column(seq).to_pylist()
            some = [i for i, t in enumerate(texts) if t]
            upto = np.cumsum([len(texts[i]) for i in some])
            rows: list[list[float] | None] = [None] * len(texts)
            lo = 0
            while lo < len(some):  # about 4 million numbers at a time
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 4_000_000 // len(matrix), "right")))
                for i, x in zip(some[lo:hi], (means([texts[i] for i in some[lo:hi]]) @ matrix.T).tolist()):
                    rows[i] = x
                lo = hi
            keep = [i for i, c in enumerate(b.schema.names) if c != seq]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(rows, pa.list_(pa.float64()))], [*[b.schema.names[i] for i in keep], "x"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != seq)
    return df.mapInArrow(run, f"{kinds}, x array<double>")


def conv(x: str, y: str, k: int, sigma: float) -> float:
    """Convolutional kernel of two sequences: mean over both of k * exp((h / k - 1) / sigma^2), h the aligned equal letters of
    two padded windows. The counts h come from a table of k + 1 values."""
    h = windows(x, k) @ windows(y, k).T
    table = k * np.exp((np.arange(k + 1) / k - 1) / sigma**2)
    return float(table[np.rint(h).astype(int)].mean())


def conv_rows(df: DataFrame, width: int, by: str = "dataset") -> DataFrame:
    """(by, id, x, other columns) for the kernel kernels.Conv, which serves wherever a kernel of rows does."""
    rest = [c for c in df.columns if c not in (by, "id", "seq")]
    return df.filter(F.length("seq") > 0).select(by, "id", K.letter_codes(F.col("seq"), width).alias("x"), *rest)


def longest(*tables: DataFrame) -> int:
    """Letters of the longest sequence of all tables, at least 1."""
    return max(1, *[t.agg(F.max(F.length("seq"))).first()[0] or 1 for t in tables])


def conv_entries(left: DataFrame, right: DataFrame | None, k: int, sigma: float, by: str = "dataset", most: int = 20_000) -> DataFrame:
    """(by, i, j, k): convolutional kernel of all pairs of rows (by, id, seq) in a group; i <= j without right."""
    width = longest(left, *([right] if right is not None else []))
    sides = [conv_rows(df.select(by, "id", "seq"), width, by) if df is not None else None for df in (left, right)]
    return K.entries(sides[0], sides[1], K.Conv(sigma, k), by, most)


def mean_profile(df: DataFrame, k: int, seq: str, by: list[str]) -> DataFrame:
    """(by..., kmer, w): share of each k-mer among the positions of a sequence, averaged over the sequences of a group.

    The mean of the convolutional kernel over pairs of sequences of two groups is a sum over pairs of distinct k-mers
    weighted by their shares, so it needs no pairs of sequences.
    """
    from strandloom.operators import kmers

    some = df.filter(F.length(seq) > 0)
    shares = kmers.explode(some.select(*by, F.length(seq).alias("m"), seq), k, seq).groupBy(*by, "kmer").agg(F.sum(1 / F.col("m")).alias("w"))
    sizes = some.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    return shares.join(F.broadcast(sizes), by).select(*by, "kmer", (F.col("w") / F.col("rows")).alias("w"))


def kmer_values(profiles: DataFrame, k: int, sigma: float, by: list[str]) -> DataFrame:
    """(by..., kmer, v): the mean convolutional kernel of every possible k-mer of A, C, G, T, N and padding with each group of
    mean_profile(); N and padding equal nothing. A group is at most 6^k shares, and one task's."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in profiles.schema if f.name in by)

    def values(group: pa.Table) -> pa.Table:
        names = ["".join(x) for x in product("ACGTNZ", repeat=k)]
        codes = np.frombuffer("".join(names).encode(), np.uint8).reshape(-1, k)
        w, v = group.column("w").to_numpy(), np.zeros(len(names))
        for kmer, share in zip(group.column("kmer").to_pylist(), w.tolist()):
            h = np.zeros(len(names), np.int64)
            for j, c in enumerate(kmer):
                if c in "ACGT":
                    h += codes[:, j] == ord(c)
            v += share * k * np.exp((h / k - 1) / sigma**2)
        keys = [pa.array([group.column(c)[0].as_py()] * len(names), group.column(c).type) for c in by]
        return pa.Table.from_arrays([*keys, pa.array(names), pa.array(v)], [*by, "kmer", "v"])

    return profiles.groupBy(*by).applyInArrow(values, f"{kinds}, kmer string, v double")


def residuals(kmers: np.ndarray, chosen: np.ndarray, sigma: float) -> np.ndarray:
    """k(x, x) minus what the chosen anchors explain of it, for rows of one-hot k-mers."""
    kernel = K.KmerCosine(sigma)
    own = np.array([(kmers * kmers).sum(1) ** 0.5]).T[:, 0] ** 2
    if not len(chosen):
        return own
    low = np.linalg.cholesky(kernel.block(chosen, chosen) + 1e-10 * np.eye(len(chosen)))
    half = np.linalg.solve(low, kernel.block(chosen, kmers))
    return own - (half * half).sum(0)


def greedy_anchors(distinct: DataFrame, p: int, sigma: float, first: str | None = None) -> list[tuple[int, str, float]]:
    """(step, kmer, residual) of p anchors: the first in md5 order, then always the k-mer least explained so far (of equals
    the least in order). One distributed pass per step over the distinct k-mers; a task sends its best only.

    What is left of each k-mer, and its coordinates on the chosen anchors, are kept: a step adds one coordinate, the next row of
    the Cholesky factor, to a table that is written anew every EVERY steps; between two writings a pass makes up for the
    few steps since.
    """
    if first is None:
        row = distinct.orderBy(F.md5("kmer"), "kmer").limit(1).collect()
        if not row:
            return []
        first = row[0]["kmer"]
    kernel = K.KmerCosine(sigma)
    out, chosen = [(0, first, float((one_hot([first]) ** 2).sum()))], one_hot([first])
    state, done = distinct.select("kmer", F.array().cast("array<double>").alias("at")), 0

    def factor(z: np.ndarray) -> np.ndarray:
        return np.linalg.cholesky(kernel.block(z, z) + 1e-10 * np.eye(len(z)))

    def stepped(b: pa.RecordBatch, z: np.ndarray, low: np.ndarray, done: int) -> tuple[np.ndarray, np.ndarray]:
        """(coordinates, residual) of a batch: those after ``done`` are made from the ones before."""
        x = one_hot(b.column(0).to_pylist())
        at = np.zeros((len(z), len(x)))
        if done:
            at[:done] = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(x), done).T
        new = kernel.block(z[done:], x) - low[done:, :done] @ at[:done]
        at[done:] = np.linalg.solve(low[done:, done:], new) if len(new) else new
        return at, (x * x).sum(1) - (at * at).sum(0)

    while len(out) < p:
        low = factor(chosen)
        if len(out) - done >= EVERY:

            def kept(batches: Iterator[pa.RecordBatch], z: np.ndarray = chosen, low: np.ndarray = low, done: int = done) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        at, _ = stepped(b, z, low, done)
                        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(at.T), pa.list_(pa.float64()))], ["kmer", "at"])

            state, done = keep(state.mapInArrow(kept, "kmer string, at array<double>"), "greedy"), len(out)

        def best(batches: Iterator[pa.RecordBatch], z: np.ndarray = chosen, low: np.ndarray = low, done: int = done) -> Iterator[pa.RecordBatch]:
            top: tuple[float, str] | None = None
            for b in batches:
                if not b.num_rows:
                    continue
                r = np.round(stepped(b, z, low, done)[1], 9)
                most, names = r.max(), b.column(0)
                name = min(names[int(i)].as_py() for i in np.flatnonzero(r == most))
                if top is None or (-most, name) < (-top[0], top[1]):
                    top = float(most), name
            if top:
                yield pa.RecordBatch.from_arrays([pa.array([top[1]]), pa.array([top[0]])], ["kmer", "r"])

        found = state.mapInArrow(best, "kmer string, r double").orderBy(F.desc("r"), "kmer").limit(1).collect()
        if not found or found[0]["r"] <= 1e-9:
            break
        out.append((len(out), found[0]["kmer"], found[0]["r"]))
        chosen = np.vstack([chosen, one_hot([found[0]["kmer"]])])
    return out
