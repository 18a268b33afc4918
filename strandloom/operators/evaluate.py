"""Folds, cross-validation, grid search and voting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import vector as V
from strandloom.operators import kernels as K


def folds(df: DataFrame, k: int, by: str = "dataset", place: str = "rn", size: str = "n") -> DataFrame:
    """Adds fold: places (from 1) in k runs of size div k each; the size mod k rows left over have fold k and are never validated."""
    return df.withColumn("fold", F.least(F.expr(f"({place} - 1) div greatest({size} div {k}, 1)"), F.lit(k)).cast("int"))


def cross_validate(df: DataFrame, kernels: list[K.Kernel], k: int, by: str = "dataset", label: str = "y") -> DataFrame:
    """(by, kernel, train_scores, val_scores, train_avg, val_avg, train_std, val_std): k-fold accuracy of the
    mean-difference classifier for each kernel, population deviation; scores in the order of folds.

    df has (by, id, x, fold, y). The kernel sums of every row with every fold and class are made once; all folds, for all
    kernels, are combinations of those sums (the Gram matrix is never taken apart again).
    """
    cells = 2 * (k + 1)
    celled = df.withColumn("cell", F.col("fold") * 2 + F.col(label))
    sums = K.class_sums(celled, celled, kernels, cells, "cell", by).join(df.select(by, "id", "fold", label), [by, "id"])
    sizes = celled.groupBy(by).agg(*[F.sum((F.col("cell") == c).cast("long")).alias(f"n{c}") for c in range(cells)])
    # sums over the training part of fold f: everything but fold f
    def total(prefix: str, f: int, c: int) -> F.Column:
        return reduce(lambda a, b: a + b, [F.col(f"{prefix}{2 * g + c}") for g in range(k + 1) if g != f])

    per_fold = []
    for f in range(k):
        part = sums.join(F.broadcast(sizes), by).select(by, "kernel", "id", "fold", F.col(label).alias("y"), *[total("s", f, c).alias(f"s{c}") for c in (0, 1)], *[total("n", f, c).alias(f"n{c}") for c in (0, 1)])
        per_fold.append(part.withColumn("f", F.lit(f)))
    all_ = reduce(DataFrame.unionAll, per_fold)
    inner = all_.filter("fold <> f")
    b = inner.groupBy(by, "kernel", "f").agg(*[(F.sum(F.when(F.col("y") == c, F.col(f"s{c}"))) / F.max(F.col(f"n{c}") * F.col(f"n{c}"))).alias(f"m{c}") for c in (0, 1)])
    b = b.select(by, "kernel", "f", ((F.col("m0") - F.col("m1")) / 2).alias("b"))
    scored = all_.join(F.broadcast(b), [by, "kernel", "f"]).withColumn("hit", (V.to_class(F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0") + F.col("b")) == F.col("y")).cast("double"))
    each = scored.groupBy(by, "kernel", "f").agg(F.avg(F.when(F.col("fold") != F.col("f"), F.col("hit"))).alias("train"), F.avg(F.when(F.col("fold") == F.col("f"), F.col("hit"))).alias("val"))
    return summary(each, [by, "kernel"])


def summary(each: DataFrame, by: list[str]) -> DataFrame:
    """Scores (by..., f, train, val) of folds as lists, averages and population deviations."""
    def scores(s: str) -> F.Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("f", s))), lambda x: x[s]).alias(f"{s}_scores")

    lists = [scores(s) for s in ("train", "val")]
    numbers = [fn(s).alias(f"{s}_{name}") for name, fn in (("avg", F.avg), ("std", F.stddev_pop)) for s in ("train", "val")]
    return each.groupBy(*by).agg(*lists, *numbers)


def grid(spark, **values: list) -> DataFrame:
    """All combinations, one column a parameter, numbered by run from 0 in the order of the arguments (the last runs fastest)."""
    out, n = None, 1
    for name, vs in values.items():
        part = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], f"i_{name} long, {name} {'int' if all(isinstance(v, int) for v in vs) else 'double'}")
        out = part if out is None else out.crossJoin(part)
    run = F.lit(0).cast("long")
    for name, vs in values.items():
        run = run * len(vs) + F.col(f"i_{name}")
        n *= len(vs)
    return out.select(run.alias("run"), *values)


def best(runs: DataFrame, by: str = "dataset", score: str = "val_avg", order: str = "run") -> DataFrame:
    """The best run of each group: highest score, of equals the first; runs that score 0 or nothing are never taken."""
    w = Window.partitionBy(by).orderBy(F.desc(score), order)
    return runs.filter(F.col(score) > 0).withColumn("__place", F.row_number().over(w)).filter("__place = 1").drop("__place")


def latest(predictions: DataFrame) -> DataFrame:
    """(model, id, bound): the valid prediction (0 or 1) saved last of each model and record."""
    valid = predictions.filter("bound in (0, 1) and model is not null and id is not null")
    return valid.groupBy("model", "id").agg(F.max_by("bound", F.struct("saved_at", "bound")).alias("bound"))


def vote(predictions: DataFrame, id_col: str = "id", bound: str = "bound") -> DataFrame:
    """(Id, Bound): 1 where more than half of the votes are 1; ties give 0."""
    return predictions.groupBy(F.col(id_col).alias("Id")).agg((F.avg(bound) > 0.5).cast("int").alias("Bound"))


def agreement(predictions: DataFrame) -> DataFrame:
    """(a, b, n_common, n_equal) of each two models."""
    x, y = predictions.selectExpr("model as a", "id", "bound as ba"), predictions.selectExpr("model as b", "id", "bound as bb")
    return x.join(y, "id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_common"), F.sum((F.col("ba") == F.col("bb")).cast("long")).alias("n_equal"))
