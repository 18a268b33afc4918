"""Profiles of sequence tables: statistics per row, duplicates, label conflicts, complement hits, description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as S


def base_counts(df: DataFrame, seq: str = "seq") -> DataFrame:
    c = F.col(seq)
    return df.withColumns({"seq_length": F.length(c)} | {f"{b}s": S.base_count(c, b) for b in S.BASES})


def longest_runs(df: DataFrame, seq: str = "seq", compat: bool = False) -> DataFrame:
    """Adds {A,T,C,G}_longest, Longest and Longest_char."""
    out = df.withColumns({f"{b}_longest": S.longest_run(F.col(seq), b, compat) for b in S.BASES})
    most, which = S.longest_base({b: F.col(f"{b}_longest") for b in S.BASES})
    return out.withColumns({"Longest": most, "Longest_char": which})


def copies(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds unique_all, how many rows have the same sequence. Counted before it is joined, so a sequence that a
    third of all rows repeat is one row of the counts; no window over its rows is sorted."""
    counts = df.groupBy(seq).agg(F.count(F.lit(1)).alias("unique_all"))
    return df.join(counts.withColumnRenamed(seq, "__seq"), F.col(seq).eqNullSafe(F.col("__seq"))).drop("__seq")


def label_conflicts(df: DataFrame, seq: str = "seq", label: str = "label") -> DataFrame:
    """(seq, n_labels) of the sequences that have several labels, all groups checked."""
    each = df.filter(F.col(label).isNotNull() & F.col(seq).isNotNull()).groupBy(seq, label).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(seq).agg(F.count(F.lit(1)).alias("n_labels")).filter("n_labels > 1")


def complement_hits(df: DataFrame, seq: str = "seq", reverse: bool = False, by: str = "dataset") -> DataFrame:
    """(by, counter): rows whose complement (or reverse complement) stands in the same dataset too."""
    turned = (S.reverse_complement if reverse else S.complement)(F.col(seq))
    there = df.select(F.col(by).alias("d"), F.col(seq).alias("s")).distinct()
    each = df.groupBy(by, seq).agg(F.count(F.lit(1)).alias("n")).withColumn("turned", turned)
    hits = each.join(there, (F.col(by) == F.col("d")) & (F.col("turned") == F.col("s")), "left_semi")
    return hits.groupBy(by).agg(F.sum("n").alias("counter"))


def describe(df: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """(by..., metric, count, mean, std, min, p25, p50, p75, max): sample deviation, exact interpolated quartiles."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")).select(*by, "m.*")
    quartiles = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy(*by, "metric").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), quartiles.alias("q"), F.max("v").alias("max"))
    return out.select(*by, "metric", "count", "mean", "std", "min", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "max")


def ranked(df: DataFrame, by: str, key: Column, name: str = "rn") -> DataFrame:
    """Adds the place, from 1, in the order of md5(key) within by: a shuffle that is the same everywhere.

    Rows are numbered within slices of the hash, 4,096 a group, and slices by the counts of those before them, so a group
    of any size is numbered in parallel.
    """
    hashed = df.withColumns({"__h": F.md5(key.cast("string"))}).withColumn("__slice", F.substring("__h", 1, 3))
    sizes = hashed.groupBy(F.col(by).alias("__by"), F.col("__slice").alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__by").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__by", "__s", F.coalesce(before, F.lit(0)).alias("__before"))
    inner = hashed.withColumn("__place", F.row_number().over(Window.partitionBy(by, "__slice").orderBy("__h")))
    out = inner.join(F.broadcast(offsets), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__slice") == F.col("__s")))
    return out.withColumn(name, (F.col("__place") + F.col("__before")).cast("int")).drop("__h", "__slice", "__by", "__s", "__before", "__place")
