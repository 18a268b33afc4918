"""Linear models on embeddings, by MLlib."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _features(df: DataFrame) -> DataFrame:
    return df.filter("x is not null").withColumn("features", array_to_vector("x"))


def logistic(train: DataFrame, rows: DataFrame, c: float = 100.0, label: str = "y", max_iter: int = 100) -> DataFrame:
    """rows with y_pred, by logistic regression with regularisation 1 / (n c)."""
    n = max(1, train.count())
    model = LogisticRegression(featuresCol="features", labelCol=label, regParam=1 / (n * c), elasticNetParam=0.0, standardization=False, maxIter=max_iter).fit(_features(train))
    return model.transform(_features(rows)).withColumn("y_pred", F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def ridge(train: DataFrame, rows: DataFrame, penalty: float = 1e-3, label: str = "y") -> DataFrame:
    """rows with score and y_pred, by ridge regression on labels -1 and 1."""
    signed = _features(train).withColumn("signed", 2.0 * F.col(label) - 1)
    model = LinearRegression(featuresCol="features", labelCol="signed", regParam=penalty, elasticNetParam=0.0, standardization=False).fit(signed)
    return model.transform(_features(rows)).withColumn("score", F.col("prediction")).withColumn("y_pred", (F.col("score") > 0).cast("int")).drop("features", "prediction")
