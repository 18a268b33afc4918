"""k-mers of all sequences as rows, their counts, and anchors among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import profile


def explode(df: DataFrame, k: int, seq: str = "seq", padding: bool = True, circular: bool = False) -> DataFrame:
    """One row (pos, kmer) beside df's other columns for every position; padding=False leaves out windows that cross an edge."""
    keep = [c for c in df.columns if c != seq]
    out = df.select(*keep, F.col(seq), F.posexplode(S.kmers(F.col(seq), k, circular)).alias("pos", "kmer"))
    if not padding:
        out = out.filter(~S.crosses_edge(F.col(seq), F.col("pos"), k))
    return out.drop(seq)


def counts(df: DataFrame, k: int, seq: str = "seq", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., kmer, n); added up before the shuffle."""
    return explode(df.select(*by, seq), k, seq).groupBy(*by, "kmer").agg(F.count(F.lit(1)).alias("n"))


def drawn(rows: DataFrame, p: int, key: str = "kmer", seed: int = 0) -> DataFrame:
    """p random rows with replacement, with draw, from 0: the same for the same seed and rows."""
    placed = profile.ranked(rows.withColumn("__all", F.lit(0)), "__all", F.col(key), "__rn")
    n = rows.agg(F.count(F.lit(1)).alias("__n"))
    draws = rows.sparkSession.range(p).select(F.col("id").cast("int").alias("draw")).crossJoin(F.broadcast(n)).filter("__n > 0")
    draws = draws.select("draw", (F.pmod(F.xxhash64("draw", F.lit(seed)), F.col("__n")) + 1).cast("int").alias("__rn"))
    return placed.join(draws, "__rn").drop("__rn", "__all")


def anchors(distinct: DataFrame, p: int, key: str = "kmer") -> DataFrame:
    """p random rows: the first in the order of md5(key); top-p per task, no full sort."""
    return distinct.orderBy(F.md5(F.col(key)), key).limit(p)
