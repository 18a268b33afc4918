"""Mean-difference classifier (SPR): the side of the nearer class mean in the kernel's feature space.

score(z) = mean k(z, class 1) - mean k(z, class 0) + b, with b half the difference of the mean kernels within class 0
and class 1. The linear kernel needs class means only; others use block sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import vector as V
from strandloom.operators import kernels as K


def _mean_vectors(df: DataFrame, by: str, label: str) -> DataFrame:
    """(by, y, x, n): mean of the vectors of each class; summed per position, before the shuffle."""
    each = df.select(by, F.col(label).alias("y"), F.posexplode("x").alias("pos", "v"))
    means = each.groupBy(by, "y", "pos").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return means.groupBy(by, "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("x"), F.max("n").alias("n"))


def fit_linear(train: DataFrame, by: str = "dataset", label: str = "y") -> DataFrame:
    """Model (by, x0, x1, m0, m1, b): class means and mean kernels within the classes."""
    means = _mean_vectors(train, by, label)
    wide = means.groupBy(by).agg(F.max(F.when(F.col("y") == 0, F.col("x"))).alias("x0"), F.max(F.when(F.col("y") == 1, F.col("x"))).alias("x1"))
    m0, m1 = V.dot(F.col("x0"), F.col("x0")), V.dot(F.col("x1"), F.col("x1"))
    return wide.select(by, "x0", "x1", m0.alias("m0"), m1.alias("m1"), ((m0 - m1) / 2).alias("b"))


def predict_linear(model: DataFrame, rows: DataFrame, by: str = "dataset") -> DataFrame:
    """Adds score and y_pred. The model has one row a group."""
    out = rows.join(F.broadcast(model), by).withColumn("score", V.dot(F.col("x"), F.col("x1")) - V.dot(F.col("x"), F.col("x0")) + F.col("b"))
    return out.withColumn("y_pred", V.to_class(F.col("score"))).drop("x0", "x1", "m0", "m1", "b")


def _class_sizes(train: DataFrame, by: str, label: str) -> DataFrame:
    return train.groupBy(by).agg(*[F.sum((F.col(label) == c).cast("long")).alias(f"n{c}") for c in (0, 1)])


def bias(train: DataFrame, kernel: K.Kernel, by: str = "dataset", label: str = "y") -> DataFrame:
    """(by, m0, m1, b) for any kernel: means over all pairs of a class, the diagonal included."""
    sums = K.class_sums(train, train, [kernel], 2, label, by).join(train.select(by, "id", label), [by, "id"])
    own = sums.groupBy(by).agg(*[F.sum(F.when(F.col(label) == c, F.col(f"s{c}"))).alias(f"t{c}") for c in (0, 1)])
    m = [F.col(f"t{c}") / (F.col(f"n{c}") * F.col(f"n{c}")) for c in (0, 1)]
    return own.join(_class_sizes(train, by, label), by).select(by, m[0].alias("m0"), m[1].alias("m1"), ((m[0] - m[1]) / 2).alias("b"))


def predict(train: DataFrame, rows: DataFrame, kernel: K.Kernel, by: str = "dataset", label: str = "y") -> DataFrame:
    """rows with score and y_pred, for any kernel."""
    sums = K.class_sums(rows, train, [kernel], 2, label, by)
    model = bias(train, kernel, by, label).join(_class_sizes(train, by, label), by)
    out = sums.join(F.broadcast(model), by).select(by, "id", (F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0") + F.col("b")).alias("score"))
    return rows.join(out, [by, "id"]).withColumn("y_pred", V.to_class(F.col("score")))


def accuracy(predicted: DataFrame, by: str = "dataset", label: str = "y") -> DataFrame:
    return predicted.groupBy(by).agg(F.avg((F.col(label) == F.col("y_pred")).cast("double")).alias("accuracy"))
