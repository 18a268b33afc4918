"""Command line: final pipeline, tuning with cross-validation, tuning on stored embeddings, embeddings, greedy anchors."""

from __future__ import annotations

import argparse
import logging
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import evaluate, kernels as K, kmers, nystrom, profile, svm
from strandloom.plans import pipeline
from strandloom.plans.shared import keep
from strandloom.plans.ship import ship
from strandloom.sources import files

LOG = logging.getLogger("strandloom")


def values(low: float, high: float, count: int, log: bool) -> list[float]:
    """count values from low to high, as powers of ten with log."""
    return [float(v) for v in (np.logspace if log else np.linspace)(low, high, count)]


def _range(parser: argparse.ArgumentParser, name: str, low: float, high: float, count: int, log: bool) -> None:
    parser.add_argument(f"--{name}-min", type=float, default=low)
    parser.add_argument(f"--{name}-max", type=float, default=high)
    parser.add_argument(f"--{name}-num", type=int, default=count)
    parser.add_argument(f"--{name}-logscale", action=argparse.BooleanOptionalAction, default=log)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom")
    sub = p.add_subparsers(dest="command", required=True)
    final = sub.add_parser("final")
    tune = sub.add_parser("tune")
    stored = sub.add_parser("tune-embeddings")
    embed = sub.add_parser("embed")
    greedy = sub.add_parser("greedy")
    for x in (tune, stored):
        x.add_argument("-c", "--clf", choices=["SVM", "SPR"], default="SVM")
        x.add_argument("-k", "--kernel", choices=["Gaussian", "Linear", "Conv"] if x is tune else ["Gaussian", "Linear"], default="Gaussian")
        x.add_argument("--k-fold", type=int, default=5)
    _range(tune, "lambda", -7, -4, 10, True)
    _range(tune, "gamma", 50, 600, 51, False)
    _range(tune, "sigma", 0.3, 0.5, 3, False)
    _range(tune, "window-size", 8, 12, 3, False)
    tune.add_argument("--precomputed", action="store_true", help="write each Gram matrix once and cut the folds from it (SVM)")
    tune.add_argument("--log", help="file to log all runs to, beside the console")
    _range(stored, "lambda", -9, -5, 2, True)
    _range(stored, "gamma", 100, 300, 2, False)
    embed.add_argument("--window-size", type=int, nargs="+", default=[9, 10, 11])
    embed.add_argument("--sigma", type=float, nargs="+", default=[0.35, 0.4, 0.45])
    embed.add_argument("--anchors", type=int, default=6000)
    embed.add_argument("--beta", type=float, default=1e-3)
    greedy.add_argument("--batch", type=int, default=20)
    greedy.add_argument("--n-anchors-per-batch", type=int, default=300)
    for x in (final, tune, embed, greedy):
        x.add_argument("--data", required=True)
    for x in (final, embed, greedy):
        x.add_argument("--out", required=True)
    stored.add_argument("--embeddings", required=True)
    for x in (final, tune, stored, embed, greedy):
        x.add_argument("--datasets", type=int, nargs="+", default=[0, 1, 2])
    return p


def placed(df: DataFrame, k: int) -> DataFrame:
    """Rows with their fold, in md5 order within each dataset."""
    sizes = df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    return evaluate.folds(profile.ranked(df, "dataset", F.col("id")).join(F.broadcast(sizes), "dataset"), k)


def kernels(kernel: str, gammas: list[float], sigmas: list[float], windows: list[int]) -> list[tuple[K.Kernel, dict[str, float]]]:
    """Kernels of a grid with their parameters; the last parameter runs fastest."""
    if kernel == "Conv":
        return [(K.Conv(s, w), {"gamma": 0.0, "sigma": s, "window_size": w}) for s in sigmas for w in windows]
    if kernel == "Gaussian":
        return [(K.Gaussian(g), {"gamma": g, "sigma": 0.0, "window_size": 0}) for g in gammas]
    return [(K.Linear(), {"gamma": 0.0, "sigma": 0.0, "window_size": 0})]


def tune(df: DataFrame, clf: str, kernel: str, gammas: list[float], lambdas: list[float], k: int, sigmas: list[float] = (), windows: list[int] = (), precomputed: bool = False) -> DataFrame:
    """(dataset, run, gamma, sigma, window_size, lam, train_avg, val_avg, ...) of all runs; lambdas run fastest, as results are
    compared in that order. precomputed: each Gram matrix is written once, and the folds take their rows and columns from it."""
    folded = keep(placed(df, k), "folded")
    some = kernels(kernel, gammas, list(sigmas), list(windows))
    if clf == "SPR":
        runs = evaluate.cross_validate(folded, [x for x, _ in some], k).withColumnRenamed("kernel", "run").withColumn("lam", F.lit(0.0))
        rows = [(i, float(p["gamma"]), float(p["sigma"]), int(p["window_size"])) for i, (_, p) in enumerate(some)]
        return runs.join(F.broadcast(df.sparkSession.createDataFrame(rows, "run int, gamma double, sigma double, window_size int")), "run")
    parts = None
    for n, (kern, p) in enumerate(some):
        if precomputed:
            scores = svm.cv_gram(keep(K.entries(folded, None, kern), "gram"), folded, lambdas, k)
        else:
            scores = svm.cv_grid(folded, kern, lambdas, k)
        each = evaluate.summary(scores, ["dataset", "run", "lam"]).withColumn("run", F.col("run") + n * len(lambdas))
        each = each.withColumns({"gamma": F.lit(float(p["gamma"])), "sigma": F.lit(float(p["sigma"])), "window_size": F.lit(int(p["window_size"]))})
        parts = each if parts is None else parts.unionByName(each)
    return parts


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    LOG.setLevel(logging.INFO)
    spark = ship(spark or SparkSession.builder.appName("strandloom").getOrCreate())
    if args.command == "final":
        return pipeline.run(spark, args.data, args.out, tuple(args.datasets))
    if args.command in ("tune", "tune-embeddings"):
        gammas = values(args.gamma_min, args.gamma_max, args.gamma_num, args.gamma_logscale)
        lambdas = values(args.lambda_min, args.lambda_max, args.lambda_num, args.lambda_logscale)
        if args.command == "tune":
            conv = args.kernel == "Conv"
            parts = [files.read_dataset(spark, args.data, d, matrix=not conv)[0].withColumn("dataset", F.lit(d)).withColumnRenamed("label", "y") for d in args.datasets]
            df = parts[0]
            for part in parts[1:]:
                df = df.unionByName(part)
            if conv:
                df = keep(nystrom.conv_rows(df, nystrom.longest(df)), "letters")
        else:
            df = files.read_embeddings(spark, args.embeddings).filter(F.col("dataset").isin(args.datasets))
        more = {}
        if args.command == "tune":
            sigmas = values(args.sigma_min, args.sigma_max, args.sigma_num, args.sigma_logscale)
            windows = [int(w) for w in values(args.window_size_min, args.window_size_max, args.window_size_num, args.window_size_logscale)]
            more = {"sigmas": sigmas, "windows": windows, "precomputed": args.precomputed}
            if args.log:
                LOG.addHandler(logging.FileHandler(args.log))
        runs = keep(tune(df, args.clf, args.kernel, gammas, lambdas, args.k_fold, **more), "runs")
        for r in runs.orderBy("dataset", "run").toLocalIterator():  # one row a run
            LOG.info("%s", {c: r[c] for c in ("dataset", "run", "gamma", "sigma", "window_size", "lam", "train_avg", "val_avg", "train_std", "val_std")})
        best = evaluate.best(runs)
        for r in best.orderBy("dataset").collect():
            LOG.info("dataset %s: best %s", r["dataset"], r.asDict())
        return best
    trains = {d: files.read_dataset(spark, args.data, d)[0] for d in args.datasets}
    if args.command == "embed":
        for d, train in trains.items():
            for k in args.window_size:
                names = sorted(r[0] for r in kmers.anchors(kmers.counts(train, k), args.anchors).collect())
                for sigma in args.sigma:
                    x = nystrom.embed(train, "seq", names, sigma, args.beta).withColumnRenamed("label", "y")
                    files.write_embeddings(x.withColumns({"dataset": F.lit(d), "sigma": F.lit(sigma), "k": F.lit(k)}), os.path.join(args.out, f"d{d}_s{sigma}_k{k}"))
        return spark.read.option("recursiveFileLookup", False).parquet(*[os.path.join(args.out, f"d{d}_s{s}_k{k}") for d in trains for s in args.sigma for k in args.window_size])
    rows = []
    for d, train in trains.items():
        k, sigma = pipeline.FEATURES["k"][d], pipeline.FEATURES["sigma"][d]
        distinct = keep(kmers.counts(train, k), "kmers")
        for b in range(args.batch):
            first = distinct.orderBy(F.md5(F.concat_ws(":", F.lit(str(b)), "kmer")), "kmer").limit(1).collect()[0]["kmer"]
            rows += [(d, b, step, kmer) for step, kmer, _ in nystrom.greedy_anchors(distinct, args.n_anchors_per_batch, sigma, first)]
    out = spark.createDataFrame(rows, "dataset int, batch int, step int, kmer string")
    files.write_anchors(out, args.out)
    return out


if __name__ == "__main__":
    main()
