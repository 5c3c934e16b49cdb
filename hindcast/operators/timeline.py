"""Event volume over time, and where the data are dense enough to test on."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_volume(events: DataFrame, time: str) -> DataFrame:
    """day, n: rows with a time on each calendar day from the first to the last, zero where there are none."""
    counts = events.where(F.col(time).isNotNull()).groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL")
    every = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return every.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def weekly_volume(daily: DataFrame) -> DataFrame:
    """Adds week: the sum of a day and the six before it. The table has one row a day, so one task orders it."""
    return daily.withColumn("week", F.sum("n").over(Window.orderBy("day").rowsBetween(-6, 0)))


def dense_end(events: DataFrame, time: str) -> DataFrame:
    """One row: first_day, typical (median positive week), end_day (last day whose week is a quarter of that or more)."""
    weeks = weekly_volume(daily_volume(events, time))
    typical = weeks.where("week > 0").agg(F.expr("percentile(week, 0.5)").alias("typical"))
    joined = weeks.crossJoin(F.broadcast(typical))
    dense = F.max(F.when(F.col("week") >= 0.25 * F.col("typical"), F.col("day")))
    return joined.agg(F.min("day").alias("first_day"), F.first("typical").alias("typical"), F.coalesce(dense, F.max("day")).alias("end_day"))


def split_table(events: DataFrame, time: str, horizon_days: int) -> DataFrame:
    """dense_end with val_day and test_day, and whether there is enough history before them."""
    found = dense_end(events, time).withColumn("test_day", F.date_sub("end_day", horizon_days)).withColumn("val_day", F.date_sub("end_day", 2 * horizon_days))
    return found.withColumn("enough", F.date_sub("val_day", 3 * horizon_days) >= F.col("first_day"))


def choose_splits(events: DataFrame, time: str, horizon_days: int) -> tuple[datetime, datetime]:
    """(val, test) as anchor times; ValueError where the history is too short."""
    row = split_table(events, time, horizon_days).first()
    if row is None or not row["enough"]:
        raise ValueError(f"not enough history for windows of {horizon_days} days")
    test = datetime.combine(row["test_day"], datetime.min.time())
    return test - timedelta(days=horizon_days), test
