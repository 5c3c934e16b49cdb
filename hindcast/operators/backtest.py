"""Scores of predictions and the constant baselines they must beat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.operators.ranks import roc_auc


def binary_metrics(df: DataFrame, label: str = "target", score: str = "prediction") -> DataFrame:
    """n, positive_rate, brier (scores clipped to 0..1), auc (null with one class)."""
    p, y = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)), F.col(label).cast("double")
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("positive_rate"), F.avg((p - y) * (p - y)).alias("brier"))
    return sums.crossJoin(F.broadcast(roc_auc(df, label, score)))


def regression_metrics(df: DataFrame, label: str = "target", score: str = "prediction") -> DataFrame:
    """n, mae, rmse, r2 (null below two rows or without variance)."""
    y, e = F.col(label).cast("double"), F.col(label) - F.col(score)
    total = F.var_pop(y) * F.count(F.lit(1))
    r2 = F.when(F.count(F.lit(1)) > 1, 1 - F.try_divide(F.sum(e * e), total))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2"))


def global_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """test with prediction: the mean training label."""
    mean = train.agg(F.avg(F.col("target").cast("double")).alias("prediction"))
    return test.crossJoin(F.broadcast(mean))


def entity_baseline(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """test with prediction: the entity's mean training label, else the mean of all."""
    own = train.groupBy(key).agg(F.avg(F.col("target").cast("double")).alias("own"))
    mean = train.agg(F.avg(F.col("target").cast("double")).alias("mean"))
    return test.join(own, key, "left").crossJoin(F.broadcast(mean)).withColumn("prediction", F.coalesce("own", "mean")).drop("own", "mean")


def join_predictions(labels: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Labels with their predictions; rows without one are left out and counted by unpredicted()."""
    return labels.join(predictions.select("timestamp", key, "prediction"), ["timestamp", key])


def unpredicted(labels: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    missing = labels.join(predictions.select("timestamp", key), ["timestamp", key], "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("n_unpredicted"))
