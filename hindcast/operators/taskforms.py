"""Label forms beyond LabelSpec: windows of prepared events, aggregated as the caller says.

`window_labels` takes any aggregate expression, `having` and population, so sets, ratios, minima, distinct counts, joined
values and two-hop links are compositions: join or filter the events first, then aggregate over (anchor, key).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators.anchors import anchor_array, in_future, in_past


def window_labels(events: DataFrame, key: str, time: str, anchors: Sequence[datetime], horizon_days: int, target: Column, having: Column | None = None) -> DataFrame:
    """timestamp, key, target of every non-null key with events in (anchor, anchor + horizon]."""
    rows = in_future(events, time, anchors, horizon_days).where(F.col(key).isNotNull())
    found = rows.groupBy("timestamp", F.col(key).alias("key")).agg(target.alias("target"), *([having.alias("_having")] if having is not None else []))
    return found.where("_having").drop("_having") if having is not None else found


def distinct_counts(events: DataFrame, key: str, time: str, anchors: Sequence[datetime], horizon_days: int, value: str) -> DataFrame:
    """timestamp, key, n: distinct values in the window, counted in two steps so that a hot key is combined map-side."""
    once = in_future(events, time, anchors, horizon_days).where(F.col(key).isNotNull()).groupBy("timestamp", F.col(key).alias("key"), value).agg(F.lit(1).alias("one"))
    return once.groupBy("timestamp", "key").agg(F.count(value).alias("n"))


def active_pairs(events: DataFrame, key: str, time: str, anchors: Sequence[datetime], lookback_days: int) -> DataFrame:
    """timestamp, key with any event in (anchor - lookback, anchor]."""
    return in_past(events.select(key, time), time, anchors, lookback_days).where(F.col(key).isNotNull()).select("timestamp", F.col(key).alias("key")).distinct()


def created_population(entities: DataFrame, key: str, created: str, anchors: Sequence[datetime]) -> DataFrame:
    """timestamp, key of entities created by the anchor."""
    seen = F.filter(anchor_array(anchors), lambda a: F.col(created).cast("timestamp_ntz") <= a)
    return entities.select(F.explode(seen).alias("timestamp"), F.col(key).alias("key"))


def ever_active(events: DataFrame, key: str, time: str, anchors: Sequence[datetime]) -> DataFrame:
    """timestamp, key of entities whose first event is at the anchor or before."""
    first = events.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(time).alias("first"))
    return created_population(first, "key", "first", anchors)


def with_default(population: DataFrame, labels: DataFrame, default: Column) -> DataFrame:
    return population.join(labels, ["timestamp", "key"], "left").select("timestamp", "key", F.coalesce("target", default).alias("target"))


def repeat_labels(labels: DataFrame) -> DataFrame:
    """Binary labels of entities for which one of the two previous anchors' labels was 1."""
    before = F.max("target").over(Window.partitionBy("key").orderBy("timestamp").rowsBetween(-2, -1))
    return labels.withColumn("before", before).where("before = 1").drop("before")


def repeat_label_form(events: DataFrame, key: str, time: str, anchors: Sequence[datetime], horizon_days: int, hit: Column) -> DataFrame:
    """Whether the window has a hit, for entities that had one in the two windows before.

    With several anchors those are the two previous anchors' labels. One anchor, as at a live prediction, has none before it:
    its population are the keys with a hit in (anchor - 2 * horizon, anchor].
    """
    found = window_labels(events, key, time, anchors, horizon_days, F.max(F.when(hit, 1).otherwise(0)))
    if len(set(anchors)) > 1:
        return repeat_labels(found)
    return found.join(active_pairs(events.where(hit), key, time, anchors, 2 * horizon_days), ["timestamp", "key"], "left_semi")


def anchored_before(rows: DataFrame, column: str) -> DataFrame:
    """Rows (with timestamp) whose column is before their anchor."""
    return rows.where(F.col(column).cast("timestamp_ntz") < F.col("timestamp"))


__all__ = ["active_pairs", "anchored_before", "created_population", "distinct_counts", "ever_active", "repeat_label_form", "repeat_labels", "window_labels", "with_default"]
