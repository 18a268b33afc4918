"""Kernels, as column expressions for pairs and as matrix products for blocks, and their bulk forms.

All pairs of n rows are n * n values by definition. Bulk forms therefore work on blocks of rows: a block is one row of a
table, every block of one side is sent to every block of the other side of its group (the dataset), by an equi-join on
group and block number that spreads the meetings evenly, and each meeting is one matrix product. What a caller needs
are mostly sums over one side; those are reduced inside the block (class_sums), so only one short row per input row
and block is shuffled, never the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import vector as V

BLOCK = 1024


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


class Kernel:
    """Implement pair() for expressions and block() for matrices of rows."""

    def pair(self, a: Column, b: Column) -> Column:
        raise NotImplementedError

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        raise NotImplementedError


@dataclass(frozen=True)
class Linear(Kernel):
    def pair(self, a: Column, b: Column) -> Column:
        return V.dot(a, b)

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a @ b.T


@dataclass(frozen=True)
class Gaussian(Kernel):
    gamma: float

    def pair(self, a: Column, b: Column) -> Column:
        return F.exp(-self.gamma * V.distance2(a, b))

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * squared_distances(a, b))


@dataclass(frozen=True)
class Polynomial(Kernel):
    c: float = 1.0
    degree: int = 2

    def pair(self, a: Column, b: Column) -> Column:
        return F.pow(V.dot(a, b) + self.c, F.lit(self.degree))

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a @ b.T + self.c) ** self.degree


@dataclass(frozen=True)
class Laplace(Kernel):
    gamma: float

    def pair(self, a: Column, b: Column) -> Column:
        return F.exp(-self.gamma * V.distance1(a, b))

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([np.exp(-self.gamma * np.abs(b - row).sum(1)) for row in a]) if len(a) else np.empty((0, len(b)))


@dataclass(frozen=True)
class KmerCosine(Kernel):
    """norm(a) norm(b) exp((cos(a, b) - 1) / sigma^2); 0 for a zero vector."""

    sigma: float

    def pair(self, a: Column, b: Column) -> Column:
        n = V.norm(a) * V.norm(b)
        return F.when(n > 0, n * F.exp((V.dot(a, b) / n - 1) / self.sigma**2)).otherwise(0.0)

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        return n * np.exp((np.divide(a @ b.T, n, out=np.ones_like(n), where=n > 0) - 1) / self.sigma**2)


@dataclass(frozen=True)
class KmerDistance(Kernel):
    """n exp(-|a - b|^2 / (2 n sigma^2)) with n = norm(a) norm(b); equals KmerCosine where the norms are equal."""

    sigma: float

    def pair(self, a: Column, b: Column) -> Column:
        n = V.norm(a) * V.norm(b)
        return F.when(n > 0, n * F.exp(-V.distance2(a, b) / (2 * n * self.sigma**2))).otherwise(0.0)

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        return n * np.exp(-np.divide(squared_distances(a, b), 2 * n * self.sigma**2, out=np.zeros_like(n), where=n > 0))


@dataclass(frozen=True)
class Conv(Kernel):
    """Convolutional kernel of whole sequences: the mean over all places of both of k exp((h / k - 1) / sigma^2), h the
    aligned equal letters of two windows of k letters centred there. Rows are letter_codes(); empty sequences give 0.

    Work is by blocks: one product gives the h of all windows of a row with those of a block, and a table of k + 1 values the rest.
    """

    sigma: float
    k: int

    def windows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(one-hot windows of all rows below each other, windows of each row); letters other than A, C, G, T are zeros."""
        codes = np.asarray(codes).astype(np.int8)
        lengths = (codes >= 0).sum(1)
        left, right = (self.k + 1) // 2 - 1, (self.k + 2) // 2 - 1
        flat = np.zeros((len(codes), codes.shape[1] + left + right, 4), np.float32)
        flat[:, left : left + codes.shape[1]] = np.eye(5, dtype=np.float32)[:, 1:][np.maximum(codes, 0)]
        each = np.lib.stride_tricks.sliding_window_view(flat.reshape(len(codes), -1), 4 * self.k, axis=1)[:, ::4]
        return each[np.arange(each.shape[1])[None, :] < lengths[:, None]], lengths

    def table(self) -> np.ndarray:
        return self.k * np.exp((np.arange(self.k + 1) / self.k - 1) / self.sigma**2)

    def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)))
        if not len(a) or not len(b):
            return out
        (x, nx), (y, ny) = self.windows(a), self.windows(b)
        table, some, first = self.table(), np.flatnonzero(ny), np.append(0, np.cumsum(nx))
        starts = (np.cumsum(ny) - ny)[some]
        for i in np.flatnonzero(nx):
            values = table[(x[first[i] : first[i + 1]] @ y.T + 0.5).astype(np.uint8)]
            out[i, some] = np.add.reduceat(values.sum(0), starts) / (nx[i] * ny[some])
        return out

    def pairs(self, a: np.ndarray, b: np.ndarray, chunk: int = 128) -> np.ndarray:
        """The kernel of each row of a with the row of b beside it."""
        out, table = np.zeros(len(a)), self.table()
        for lo in range(0, len(a), chunk):
            (x, nx), (y, ny) = self.windows(a[lo : lo + chunk]), self.windows(b[lo : lo + chunk])
            both = []
            for flat, n in ((x, nx), (y, ny)):
                wide = np.zeros((len(n), max(1, int(n.max(initial=0))), 4 * self.k), np.float32)
                wide[np.arange(wide.shape[1])[None, :] < n[:, None]] = flat
                both.append(wide)
            values = table[(both[0] @ both[1].transpose(0, 2, 1) + 0.5).astype(np.uint8)]
            inside = (np.arange(values.shape[1])[None, :] < nx[:, None])[:, :, None] & (np.arange(values.shape[2])[None, :] < ny[:, None])[:, None, :]
            out[lo : lo + chunk] = (values * inside).sum((1, 2)) / np.maximum(nx * ny, 1)
        return out


def letter_codes(seq: Column, width: int) -> Column:
    """A sequence as numbers for Conv: 1 to 4 for A, C, G, T, 0 for other letters, -1 behind the end up to ``width``."""
    letters = F.split(F.rpad(F.coalesce(seq, F.lit("")), F.lit(width), F.lit(" ")), "")
    return F.transform(letters, lambda c: F.when(c == " ", -1.0).otherwise(F.coalesce(F.array_position(F.array(*[F.lit(x) for x in "ACGT"]), c), F.lit(0)).cast("double")))


REGISTRY = {"Linear": Linear, "Gaussian": Gaussian, "Polynomial": Polynomial, "Laplace": Laplace, "KmerCosine": KmerCosine, "KmerDistance": KmerDistance, "Conv": Conv}


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def blocks(df: DataFrame, by: str, size: int | None = None, cell: str | None = None) -> DataFrame:
    """(by, part, parts, ids, x, cells, d): rows (by, id, x) gathered into blocks of about size rows, as bytes."""
    size = size or BLOCK
    counts = _parts(df, by, size)
    dealt = df.select(by, "id", "x", (F.coalesce(F.col(cell).cast("int"), F.lit(0)) if cell else F.lit(0)).alias("cell")).join(counts, by)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def gather(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), matrix(table.column("x"))
        order = np.argsort(ids, kind="stable")
        row = {by: table.column(by)[:1], "part": table.column("part")[:1], "parts": table.column("parts")[:1], "ids": pa.array([ids[order].tobytes()]), "x": pa.array([x[order].tobytes()]), "cells": pa.array([table.column("cell").to_numpy()[order].astype(np.int32).tobytes()]), "d": pa.array([x.shape[1]], pa.int32())}
        return pa.table(row)

    kind = df.schema[by].dataType.simpleString()
    return dealt.groupBy(by, "part").applyInArrow(gather, f"{by} {kind}, part int, parts int, ids binary, x binary, cells binary, d int")


def _parts(df: DataFrame, by: str, size: int) -> DataFrame:
    """(by, parts): the number of blocks of each group."""
    return df.groupBy(by).agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).cast("int").alias("parts"))


def _meet(left: DataFrame, right: DataFrame | None, by: str, cell: str | None = None) -> DataFrame:
    """Every block of left with every block of right in its group; without right, each two blocks of left once."""
    mine = blocks(left, by, cell=cell)
    other = mine if right is None else blocks(right, by, cell=cell)
    if right is None:
        sent = mine.withColumn("r_part", F.explode(F.sequence("part", F.col("parts") - 1)))
    else:
        sent = mine.join(_parts(right, by, BLOCK).withColumnRenamed("parts", "n"), by).withColumn("r_part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    return sent.join(other.withColumnsRenamed({c: f"r_{c}" for c in other.columns if c != by}), [by, "r_part"])


def _sides(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    def get(name: str, dtype: type) -> np.ndarray:
        return np.frombuffer(b.column(name)[i].as_py(), dtype)

    d, e = b.column("d")[i].as_py(), b.column("r_d")[i].as_py()
    return get("ids", np.int64), get("x", float).reshape(-1, d), get("r_ids", np.int64), get("r_x", float).reshape(-1, e), get("r_cells", np.int32)


def entries(left: DataFrame, right: DataFrame | None, kernel: Kernel, by: str = "dataset", most: int = 200_000) -> DataFrame:
    """(by, i, j, k): kernel values of all rows of left with all of right in the same group; without right the Gram matrix, i <= j.

    The result has n * m rows. Groups of more than ``most`` rows are refused: use Nystrom features there.
    """
    sides = [left] + ([right] if right is not None else [])
    if (max(s.groupBy(by).count().agg(F.max("count")).first()[0] or 0 for s in sides)) > most:
        raise ValueError(f"more than {most} rows in a group: all pairs would be too many, use Nystrom features")
    gram = right is None

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                ids, x, other, y, _ = _sides(b, n)
                for lo in range(0, len(ids), 256):
                    k = kernel.block(x[lo : lo + 256], y)
                    i, j, k = np.repeat(ids[lo : lo + 256], len(other)), np.tile(other, len(k)), k.reshape(-1)
                    if gram:
                        keep = i <= j if b.column("part")[n].as_py() == b.column("r_part")[n].as_py() else slice(None)
                        i, j, k = np.minimum(i, j)[keep], np.maximum(i, j)[keep], k[keep]
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(by)[n].as_py()] * len(i), b.schema.field(by).type), pa.array(i), pa.array(j), pa.array(k)], [by, "i", "j", "k"])

    kind = left.schema[by].dataType.simpleString()
    return _meet(left, right, by).mapInArrow(values, f"{by} {kind}, i long, j long, k double")


def class_sums(left: DataFrame, right: DataFrame, kernels: list[Kernel], cells: int, cell: str, by: str = "dataset") -> DataFrame:
    """(by, id, kernel, s0, ..): for each row of left and kernel, the sums of the kernel with the rows of right in each cell.

    cell: column of right with numbers from 0 to cells - 1. Each meeting of blocks gives one row per left row and kernel.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                ids, x, _, y, c = _sides(b, n)
                member = np.zeros((len(c), cells))
                member[np.arange(len(c)), c] = 1
                for number, kernel in enumerate(kernels):
                    s = kernel.block(x, y) @ member
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(by)[n].as_py()] * len(ids), b.schema.field(by).type), pa.array(ids), pa.array(np.full(len(ids), number), pa.int32()), *[pa.array(np.ascontiguousarray(s[:, i])) for i in range(cells)]], [by, "id", "kernel", *[f"s{i}" for i in range(cells)]])

    kind = left.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, id long, kernel int, " + ", ".join(f"s{i} double" for i in range(cells))
    right = right.filter(F.col(cell).isNotNull())
    met = _meet(left.withColumn(cell, F.lit(0)) if cell not in left.columns else left, right, by, cell).mapInArrow(sums, schema)
    return met.groupBy(by, "id", "kernel").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(cells)])


def centred(gram: DataFrame, by: str = "dataset") -> DataFrame:
    """(by, i, j, kc) of a Gram matrix (by, i, j, k), i <= j: k minus the means of both rows plus the mean of all."""
    full = gram.select(by, "i", "j", "k").unionAll(gram.filter("i < j").select(by, F.col("j").alias("i"), F.col("i").alias("j"), "k"))
    row = full.groupBy(by, "i").agg(F.avg("k").alias("m"))
    all_ = row.groupBy(by).agg(F.avg("m").alias("g"))
    out = gram.join(row, [by, "i"]).join(row.select(by, F.col("i").alias("j"), F.col("m").alias("mj")), [by, "j"]).join(F.broadcast(all_), by)
    return out.select(by, "i", "j", (F.col("k") - F.col("m") - F.col("mj") + F.col("g")).alias("kc"))
