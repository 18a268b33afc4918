"""Readers and writers of the project's files: matrices, sequences, labels, predictions, embeddings, anchors."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _with_position(lines: DataFrame) -> DataFrame:
    """Numbers the lines of files in their order, from 0, by file name and place in the file; no global sort.

    Lines are counted per input partition first; only those counts, one a partition, pass through one task.
    """
    part = lines.withColumn("part", F.spark_partition_id()).withColumn("in_part", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    before = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file"))
    before = before.withColumn("offset", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("offset", F.lit(0)).alias("offset"))
    return part.join(F.broadcast(before), "part").withColumn("pos", F.col("in_part") + F.col("offset")).drop("part", "in_part", "offset")


def read_matrix(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """(pos, x): rows of numbers without a header, as array<double>; pos is the line's place in one file."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    numbered = _with_position(lines)
    return numbered.select("pos", F.transform(F.split(F.trim("value"), f"{sep}+"), lambda v: v.cast("double")).alias("x"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq): comma-separated with a header; the second column is the sequence."""
    df = spark.read.option("header", True).schema("id long, seq string").option("mode", "FAILFAST").option("enforceSchema", True).csv(path)
    return df.select("id", F.trim("seq").alias("seq"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label): comma-separated with a header; the second column is the label."""
    return spark.read.option("header", True).schema("id long, label int").option("mode", "FAILFAST").option("enforceSchema", True).csv(path)


def read_dataset(spark: SparkSession, folder: str, dataset: int, matrix: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one dataset: features joined with labels by place; train (id, x or seq, label), test (id, x or seq)."""
    suffix = "_mat100" if matrix else ""
    paths = {s: os.path.join(folder, f"X{s}{dataset}{suffix}.csv") for s in ("tr", "te")}
    if matrix:
        x = {s: read_matrix(spark, p).withColumnRenamed("pos", "id") for s, p in paths.items()}
        labels = read_labels(spark, os.path.join(folder, f"Ytr{dataset}.csv"))
        first = labels.agg(F.min("id").alias("first"))
        labels = labels.crossJoin(F.broadcast(first)).select((F.col("id") - F.col("first")).alias("id"), "label")
    else:
        x = {s: read_sequences(spark, p) for s, p in paths.items()}
        labels = read_labels(spark, os.path.join(folder, f"Ytr{dataset}.csv"))
    return x["tr"].join(labels, "id"), x["te"]


def read_predictions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, Id, Bound) of prediction files; source is the file's name."""
    df = spark.read.option("header", True).schema("Id int, Bound double").option("lineSep", "\n").csv(paths)
    return df.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"), "Id", "Bound")


def write_predictions(df: DataFrame, path: str, rows: int | None = 3000) -> None:
    """Writes (Id, Bound) as CSV with a header. Bound is cut to whole numbers (0.5 becomes 0); Id must run 0, 1, ... without gaps.

    rows: the number of rows there must be, None for any.
    """
    out = df.select(F.col("Id").cast("int"), F.col("Bound").cast("int"))
    n, distinct, low, high = out.agg(F.count(F.lit(1)), F.count_distinct("Id"), F.min("Id"), F.max("Id")).first()
    if rows is not None and n != rows:
        raise ValueError(f"{n} predictions instead of {rows}")
    if n and (distinct != n or low != 0 or high != n - 1):
        raise ValueError("Id must run from 0 without gaps or repeats")
    out.orderBy("Id").write.option("header", True).mode("overwrite").csv(path)


def constant_predictions(spark: SparkSession, rows: int = 3000, value: int = 0) -> DataFrame:
    return spark.range(rows).select(F.col("id").cast("int").alias("Id"), F.lit(value).alias("Bound"))


def write_embeddings(df: DataFrame, path: str) -> None:
    """(dataset, sigma, k, id, x) as Parquet in a folder per dataset, sigma and k."""
    df.write.mode("overwrite").partitionBy("dataset", "sigma", "k").parquet(path)


def read_embeddings(spark: SparkSession, path: str, dataset: int | None = None, sigma: float | None = None, k: int | None = None) -> DataFrame:
    """Embeddings again; what is given prunes the folders that are read."""
    df = spark.read.parquet(path)
    for name, value in (("dataset", dataset), ("sigma", sigma), ("k", k)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def parse_embedding_name(name: F.Column) -> F.Column:
    """(dataset, sigma, k) of names like embedding_d0_s0.31_k9.npy; nulls where a name has another form."""
    def part(i: int) -> F.Column:
        found = F.regexp_extract(name, r"d(\d)_s([0-9.]+?)_k(\d+)", i)
        return F.when(found != "", found)

    return F.struct(part(1).cast("int").alias("dataset"), part(2).cast("double").alias("sigma"), part(3).cast("int").alias("k"))


def list_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """(path, dataset, sigma, k) of the files in a folder."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    return files.select("path", parse_embedding_name(F.element_at(F.split("path", "/"), -1)).alias("p")).select("path", "p.*")


def write_anchors(df: DataFrame, path: str) -> None:
    """(dataset, batch, step, kmer) of chosen anchors."""
    df.write.mode("overwrite").partitionBy("dataset").parquet(path)


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, batch, step, kmer) as written by write_anchors()."""
    return spark.read.schema("batch int, step int, kmer string, dataset int").parquet(path).select("dataset", "batch", "step", "kmer")
