"""The final pipeline on files: three classifiers for each dataset, their prediction files, and the vote over them."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators import evaluate, kernels as K, kmers, nystrom, svm
from strandloom.plans.shared import keep
from strandloom.sources import files

#: Fixed values of the published final run, by dataset 0, 1, 2.
MATRIX = {"gamma": (391.0, 292.0, 325.0), "lam": 1e-7}
CONV = {"k": (9, 10, 11), "sigma": (0.31, 0.31, 0.3), "lam": (1e-5, 1e-9, 1e-9)}
FEATURES = {"k": (9, 9, 7), "sigma": (0.34, 0.3, 0.3), "anchors": 6000, "beta": 1e-3, "gamma": (184.375, 481.25, 560.41667), "lam": 1e-12}


def _numbered(df: DataFrame, offset: int) -> DataFrame:
    """(Id, Bound): Id is the place of the test row within its dataset plus the test rows of those before; cut to whole numbers."""
    place = F.row_number().over(Window.partitionBy("dataset").orderBy("id")) - 1
    return df.select((place + offset).cast("int").alias("Id"), F.col("y_pred").cast("int").alias("Bound"))


def matrix_svm(spark: SparkSession, folder: str, dataset: int, offset: int, gamma: float, lam: float) -> DataFrame:
    train, test = files.read_dataset(spark, folder, dataset, matrix=True)
    train, test = (df.withColumn("dataset", F.lit(dataset)) for df in (train, test))
    kernel = K.Gaussian(gamma)
    return _numbered(svm.predict(svm.fit(train, kernel, lam, label="label"), train, test, kernel), offset)


def feature_svm(spark: SparkSession, folder: str, dataset: int, offset: int, k: int, sigma: float, anchors: int, beta: float, gamma: float, lam: float) -> DataFrame:
    train, test = files.read_dataset(spark, folder, dataset)
    train, test = (df.withColumn("dataset", F.lit(dataset)) for df in (train, test))
    names = sorted(r[0] for r in kmers.anchors(kmers.counts(train, k), anchors).collect())
    x, z = (keep(nystrom.embed(df, "seq", names, sigma, beta), "features") for df in (train, test))
    kernel = K.Gaussian(gamma)
    return _numbered(svm.predict(svm.fit(x, kernel, lam, label="label"), x, z, kernel), offset)


def conv_svm(spark: SparkSession, folder: str, dataset: int, offset: int, k: int, sigma: float, lam: float) -> DataFrame:
    sides = [df.withColumn("dataset", F.lit(dataset)) for df in files.read_dataset(spark, folder, dataset)]
    train, test = (keep(nystrom.conv_rows(df, nystrom.longest(*sides)), "letters") for df in sides)
    kernel = K.Conv(sigma, k)
    return _numbered(svm.predict(svm.fit(train, kernel, lam, label="label"), train, test, kernel), offset)


def run(spark: SparkSession, folder: str, out: str, datasets: tuple[int, ...] = (0, 1, 2), anchors: int | None = None) -> DataFrame:
    """Writes one prediction file per model and the vote Yte into out; returns the vote."""
    offsets, before = {}, 0
    for d in datasets:
        offsets[d] = before
        before += files.read_dataset(spark, folder, d)[1].count()
    models = {
        "matrix_svm": lambda d: matrix_svm(spark, folder, d, offsets[d], MATRIX["gamma"][d], MATRIX["lam"]),
        "conv_svm": lambda d: conv_svm(spark, folder, d, offsets[d], CONV["k"][d], CONV["sigma"][d], CONV["lam"][d]),
        "feature_svm": lambda d: feature_svm(spark, folder, d, offsets[d], FEATURES["k"][d], FEATURES["sigma"][d], anchors or FEATURES["anchors"], FEATURES["beta"], FEATURES["gamma"][d], FEATURES["lam"]),
    }
    for name, model in models.items():
        files.write_predictions(reduce(DataFrame.unionByName, [model(d) for d in datasets]), os.path.join(out, name), None)
    votes = files.read_predictions(spark, [os.path.join(out, name) for name in models])
    result = evaluate.vote(votes, "Id", "Bound")
    files.write_predictions(result, os.path.join(out, "Yte"), None)
    return result
