"""Support vector classifier without a bias, and kernel PCA, on Gram matrices of one group at a time.

Both need a group's whole Gram matrix, n * n numbers in one task; groups of more than MOST rows are refused. For larger
ones embed the rows first (nystrom) and use heads.logistic or the linear kernel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import vector as V
from strandloom.operators import kernels as K

MOST = 10_000


def solve(gram: np.ndarray, y: np.ndarray, lam: float, tol: float = 1e-6, max_sweeps: int = 200, shift: float = 0.0, start: np.ndarray | None = None) -> np.ndarray:
    """alpha that minimises a'Ka / 2 - (y - shift)'a with 0 <= y_i a_i <= 1 / (2 n lam); y in {-1, 1}.

    Newton steps on the alphas that are not held at a bound, cut back into the bounds, then coordinate descent where they
    come no further. What residual() says of the result is part of every model: check it where lam is very small.
    """
    n, target = len(y), y - shift
    c = np.inf if lam == 0 else 1 / (2 * n * lam)
    low, high = np.where(y > 0, 0.0, -c), np.where(y > 0, c, 0.0)
    a = np.zeros(n) if start is None else np.clip(start, low, high)
    g, ridge = gram @ a - target, 1e-12 * max(np.trace(gram) / max(n, 1), 1e-12)
    for _ in range(100):
        if np.abs(np.clip(a - g, low, high) - a).max(initial=0) < tol:
            return a
        free = ~(((a <= low) & (g > 0)) | ((a >= high) & (g < 0)))
        step = np.zeros(n)
        step[free] = -np.linalg.solve(gram[np.ix_(free, free)] + ridge * np.eye(int(free.sum())), g[free])
        t = 1.0
        while t > 1e-8:
            new = np.clip(a + t * step, low, high)
            moved = new - a
            change = gram @ moved
            if g @ moved + moved @ change / 2 < -1e-14 * max(1.0, abs(g @ moved)) and g @ moved < 0:
                break
            t /= 2
        else:
            break
        a, g = new, g + change
    diagonal = np.maximum(np.diag(gram), 1e-12)
    for _ in range(max_sweeps):
        g = gram @ a - target
        if np.abs(np.clip(a - g, low, high) - a).max(initial=0) < tol:
            break
        for i in range(n):
            new = min(max(a[i] - g[i] / diagonal[i], low[i]), high[i])
            if new != a[i]:
                g += (new - a[i]) * gram[:, i]
                a[i] = new
    return a


def solve_with_bias(gram: np.ndarray, y: np.ndarray, lam: float) -> tuple[np.ndarray, float]:
    """(alpha, bias): the sum of alpha is 0. It falls as the bias grows, so the bias is found by halving."""
    if len(np.unique(y)) < 2:
        return np.zeros(len(y)), float(np.sign(y.sum()))
    low, high = -1.0, 1.0
    tol = 1e-11  # the sum is far less exact than the gradient
    while solve(gram, y, lam, tol, shift=low).sum() < 0:
        low *= 2
    while solve(gram, y, lam, tol, shift=high).sum() > 0:
        high *= 2
    a = None
    for _ in range(60):
        bias = (low + high) / 2
        a = solve(gram, y, lam, tol, shift=bias, start=a)
        if abs(a.sum()) < 1e-9 or high - low < 1e-12:
            break
        low, high = (bias, high) if a.sum() > 0 else (low, bias)
    return a, bias


def residual(gram: np.ndarray, y: np.ndarray, a: np.ndarray, lam: float, shift: float = 0.0) -> float:
    """How far a is from optimal: the largest projected gradient step."""
    c = np.inf if lam == 0 else 1 / (2 * len(y) * lam)
    low, high = np.where(y > 0, 0.0, -c), np.where(y > 0, c, 0.0)
    return float(np.abs(np.clip(a - (gram @ a - y + shift), low, high) - a).max(initial=0))


def _guard(n: int) -> None:
    if n > MOST:
        raise ValueError(f"{n} rows in a group, at most {MOST}: embed them first (nystrom)")


_MODEL = "id long, alpha double, bias double, residual double"


def _fitted(pdf: pd.DataFrame, gram: np.ndarray, lam: float, by: str, label: str, bias: bool) -> pd.DataFrame:
    y = 2 * pdf[label].to_numpy() - 1
    a, b = solve_with_bias(gram, y, lam) if bias else (solve(gram, y, lam), 0.0)
    return pd.DataFrame({by: pdf[by], "id": pdf["id"], "alpha": a, "bias": b, "residual": residual(gram, y, a, lam, b)})


def fit(train: DataFrame, kernel: K.Kernel, lam: float, by: str = "dataset", label: str = "y", bias: bool = False) -> DataFrame:
    """Model (by, id, alpha, bias, residual), one task per group; residual tells how far its group is from optimal."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        _guard(len(pdf))
        pdf = pdf.sort_values("id")
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        return _fitted(pdf, kernel.block(x, x), lam, by, label, bias)

    return train.select(by, "id", "x", label).groupBy(by).applyInPandas(one, f"{by} {train.schema[by].dataType.simpleString()}, {_MODEL}")


def _square(ids: pd.Series, i: pd.Series, j: pd.Series, k: pd.Series) -> np.ndarray:
    """A Gram matrix from its entries i <= j, in the order of ids."""
    place = pd.Series(np.arange(len(ids)), ids.to_numpy())
    out = np.zeros((len(ids), len(ids)))
    p, q = place.reindex(i).to_numpy(), place.reindex(j).to_numpy()
    known = ~(np.isnan(p) | np.isnan(q))
    p, q = p[known].astype(int), q[known].astype(int)
    out[p, q] = out[q, p] = k.to_numpy()[known]
    return out


def fit_gram(gram: DataFrame, labels: DataFrame, lam: float, by: str = "dataset", label: str = "y", bias: bool = False) -> DataFrame:
    """Model from a stored Gram matrix (by, i, j, k), i <= j, and labels (by, id, label)."""
    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        _guard(len(right))
        right = right.sort_values("id")
        return _fitted(right, _square(right["id"], left["i"], left["j"], left["k"]), lam, by, label, bias)

    kind = gram.schema[by].dataType.simpleString()
    return gram.groupBy(by).cogroup(labels.select(*[F.col(c).alias(c) for c in (by, "id", label)]).groupBy(by)).applyInPandas(one, f"{by} {kind}, {_MODEL}")


def predict_gram(model: DataFrame, similarity: DataFrame, by: str = "dataset") -> DataFrame:
    """(by, id, score, y_pred) from a stored similarity (by, i, j, k) of rows i with training rows j."""
    used = model.select(by, F.col("id").alias("j"), "alpha", "bias")
    sums = similarity.join(used, [by, "j"]).groupBy(by, F.col("i").alias("id")).agg((F.sum(F.col("alpha") * F.col("k")) + F.first("bias")).alias("score"))
    return sums.withColumn("y_pred", V.to_class(F.col("score")))


def cv_gram(gram: DataFrame, rows: DataFrame, lams: list[float], k: int, by: str = "dataset", label: str = "y") -> DataFrame:
    """As cv_grid(), from a stored Gram matrix (by, i, j, k), i <= j, of which each fold takes its rows and columns; rows (by, id, y, fold)."""
    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        _guard(len(right))
        right = right.sort_values("id")
        whole = _square(right["id"], left["i"], left["j"], left["k"])
        return pd.concat([_scores(right, whole, lams, f, by, label) for f in range(k)])

    kind = gram.schema[by].dataType.simpleString()
    named = rows.select(*[F.col(c).alias(c) for c in (by, "id", label, "fold")])
    return gram.groupBy(by).cogroup(named.groupBy(by)).applyInPandas(one, f"{by} {kind}, {_SCORES}")


_SCORES = "run int, lam double, f int, train double, val double"


def _scores(pdf: pd.DataFrame, gram: np.ndarray, lams: list[float], f: int, by: str, label: str) -> pd.DataFrame:
    """Accuracies of one fold, by lambda."""
    y, val, out = pdf[label].to_numpy(), pdf["fold"].to_numpy() == f, []
    for run, lam in enumerate(lams):
        a = solve(gram[np.ix_(~val, ~val)], 2 * y[~val] - 1, lam)
        pred = np.sign(gram[:, ~val] @ a) / 2 + 0.5
        out.append((pdf[by].iloc[0], run, lam, f, float((pred == y)[~val].mean()), float((pred == y)[val].mean())))
    return pd.DataFrame(out, columns=[by, "run", "lam", "f", "train", "val"])


def predict(model: DataFrame, train: DataFrame, rows: DataFrame, kernel: K.Kernel, by: str = "dataset") -> DataFrame:
    """rows with score and y_pred: sums of alpha * k, made block by block."""
    weighted = train.join(model, [by, "id"]).filter("alpha <> 0")
    sums = _weighted(rows, weighted, kernel, by)
    bias = F.broadcast(model.groupBy(by).agg(F.first("bias").alias("__bias")))  # one row a group
    out = rows.join(sums, [by, "id"], "left").join(bias, by, "left").withColumn("score", F.coalesce("score", F.lit(0.0)) + F.coalesce("__bias", F.lit(0.0)))
    return out.drop("__bias").withColumn("y_pred", V.to_class(F.col("score")))


def _weighted(rows: DataFrame, weighted: DataFrame, kernel: K.Kernel, by: str) -> DataFrame:
    """(by, id, score): alpha joins the vectors as their last number."""
    class _Weighted(K.Kernel):
        def block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return kernel.block(a, b[:, :-1]) * b[:, -1]

    joined = weighted.select(by, "id", F.concat("x", F.array("alpha")).alias("x"), F.lit(0).alias("cell"))
    return K.class_sums(rows, joined, [_Weighted()], 1, "cell", by).select(by, "id", F.col("s0").alias("score"))


def cv_grid(df: DataFrame, kernel: K.Kernel, lams: list[float], k: int, by: str = "dataset", label: str = "y") -> DataFrame:
    """(by, run, lam, f, train, val): accuracy of each fold and lambda. One task per group and fold; the Gram matrix is made
    once there and serves all lambdas. df has (by, id, x, y, fold)."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        _guard(len(pdf))
        pdf = pdf.sort_values("id")
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        return _scores(pdf, kernel.block(x, x), lams, int(pdf["f"].iloc[0]), by, label)

    kind = df.schema[by].dataType.simpleString()
    copies = df.select(by, "id", "x", label, "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("f"))
    return copies.groupBy(by, "f").applyInPandas(one, f"{by} {kind}, {_SCORES}")


def spectrum(train: DataFrame, kernel: K.Kernel, n: int = 50, by: str = "dataset") -> DataFrame:
    """(by, place, value): the n largest eigenvalues of each group's centred Gram matrix, what a plot of them shows."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        _guard(len(pdf))
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        k = kernel.block(x, x)
        mean = k.mean(0)
        values = np.linalg.eigvalsh(k - mean[None, :] - mean[:, None] + k.mean())[::-1][:n]
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(values), "place": np.arange(len(values)), "value": values})

    return train.select(by, "x").groupBy(by).applyInPandas(one, f"{by} {train.schema[by].dataType.simpleString()}, place int, value double")


def kernel_pca(train: DataFrame, rows: DataFrame, kernel: K.Kernel, n: int = 2, by: str = "dataset", compat: bool = False) -> DataFrame:
    """(by, id, pc): the n leading components of rows in the space of train, one task per group.

    Components come by falling eigenvalue, scaled by its root, and rows are centred as train is; of each component the
    largest weight is positive. compat: scaled by the eigenvalue itself, rows not centred.
    """
    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        _guard(len(left))
        if not len(left) or not len(right):
            return pd.DataFrame({by: [], "id": [], "pc": []})
        x, z = (np.stack(p.sort_values("id")["x"].to_numpy()).astype(float) for p in (left, right))
        k = kernel.block(x, x)
        mean, all_ = k.mean(0), k.mean()
        values, vectors = np.linalg.eigh(k - mean[None, :] - mean[:, None] + all_)
        values, vectors = values[::-1][:n], vectors[:, ::-1][:, :n]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
        s = kernel.block(z, x)
        if not compat:
            s = s - s.mean(1)[:, None] - mean[None, :] + all_
        scale = np.where(values > 1e-12, values if compat else np.sqrt(np.maximum(values, 0)), np.inf)
        right = right.sort_values("id")
        right["pc"] = list(s @ (vectors / scale))
        return right[[by, "id", "pc"]]

    kind = train.schema[by].dataType.simpleString()
    other = rows.select(*[F.col(c).alias(c) for c in (by, "id", "x")])  # fresh names: both may come from one table
    return train.select(by, "id", "x").groupBy(by).cogroup(other.groupBy(by)).applyInPandas(one, f"{by} {kind}, id long, pc array<double>")
