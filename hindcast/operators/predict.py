"""Fitting on past anchors, predicting at the next, and looking predictions up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_predict(train: DataFrame, test: DataFrame, columns: list[str], key: str, binary: bool, seed: int = 7, trees: bool = True) -> DataFrame:
    """timestamp, key, prediction (a probability for binary labels). train has target; nulls of features count as 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    keep = ["timestamp", key, *columns]
    train = train.select(*keep, F.col("target").cast("double").alias("target")).fillna(0, columns)
    if binary:
        model = GBTClassifier(labelCol="target", maxIter=20, maxDepth=4, seed=seed) if trees else LogisticRegression(labelCol="target", regParam=0.01)
    else:
        model = GBTRegressor(labelCol="target", maxIter=20, maxDepth=4, seed=seed) if trees else LinearRegression(labelCol="target", regParam=0.01)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), model]).fit(train)
    scored = fitted.transform(test.select(*keep).fillna(0, columns))
    prediction = vector_to_array("probability")[1] if binary else F.col("prediction")
    return scored.select("timestamp", key, prediction.alias("prediction"))


def top_k(predictions: DataFrame, key: str, k: int) -> DataFrame:
    """The k highest predictions, ties by key."""
    return predictions.orderBy(F.desc("prediction"), key).limit(k)


def lookup(predictions: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted: key as text. Predictions of those that have one, null for the rest; keys are compared as text."""
    have = predictions.select(F.col(key).cast("string").alias("key"), "prediction")
    return wanted.select("key").distinct().join(have, "key", "left")


def missing(predictions: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Wanted keys without a prediction."""
    return wanted.select("key").distinct().join(predictions.select(F.col(key).cast("string").alias("key")), "key", "left_anti")
