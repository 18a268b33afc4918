"""Scoring of rows that arrive as a stream by a fitted, static model: stateless, so it needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandloom.functions import sequence as S
from strandloom.functions import vector as V
from pyspark.sql import functions as F


def score_linear(stream: DataFrame, model: DataFrame, by: str = "dataset") -> DataFrame:
    """Adds score and y_pred to rows (by, id, x) of a stream; model is that of classify.fit_linear, one row a group."""
    out = stream.join(F.broadcast(model), by).withColumn("score", V.dot(F.col("x"), F.col("x1")) - V.dot(F.col("x"), F.col("x0")) + F.col("b"))
    return out.withColumn("y_pred", V.to_class(F.col("score"))).drop("x0", "x1", "m0", "m1", "b")


def profile(stream: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Adds the letters and base counts of each row of a stream."""
    seq = S.letters(F.col(sequence))
    return stream.withColumns({"seq": seq, "seq_length": F.length(seq)} | {f"{b}s": S.base_count(seq, b) for b in S.BASES})
