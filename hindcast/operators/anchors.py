"""Attaching anchor times to events without a join on an inequality.

Anchors are few (tens), so they travel as an array literal; an event is exploded into the anchors whose window holds it. The
work is map-side and an event is repeated only where windows overlap.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def at(when: datetime) -> Column:
    return F.lit(when.isoformat(" ")).cast("timestamp_ntz")


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def anchor_array(anchors: Sequence[datetime]) -> Column:
    return F.array(*(at(a) for a in anchors))


def anchor_table(spark: SparkSession, anchors: Sequence[datetime]) -> DataFrame:
    return spark.range(1).select(F.explode(anchor_array(anchors)).alias("timestamp"))


def _between(events: DataFrame, time: str, anchors: Sequence[datetime], after: int, until: int) -> DataFrame:
    """Rows by anchors with time in (anchor + after days, anchor + until days]; adds the column timestamp."""
    t = F.col(time).cast("timestamp_ntz")
    low, high = min(anchors), max(anchors)
    near = events.where((t > at(low) + days(after)) & (t <= at(high) + days(until)))
    held = F.filter(anchor_array(anchors), lambda a: (t > a + days(after)) & (t <= a + days(until)))
    return near.withColumn("timestamp", F.explode(held))


def in_future(events: DataFrame, time: str, anchors: Sequence[datetime], horizon_days: int) -> DataFrame:
    """(anchor, anchor + horizon]"""
    return _between(events, time, anchors, 0, horizon_days)


def in_past(events: DataFrame, time: str, anchors: Sequence[datetime], lookback_days: int) -> DataFrame:
    """(anchor - lookback, anchor]"""
    return _between(events, time, anchors, -lookback_days, 0)
