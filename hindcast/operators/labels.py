"""Labels at past anchors: LabelSpec to a DataFrame of (timestamp, entity key, target).

One aggregation over (anchor, link) of the events in the windows, combined map-side; then, unless the population is the
events' own, a left join from the population on the same keys. The `recent` population starts from the pairs of the past
windows, so anchors times entities is never formed for it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.operators.anchors import anchor_table, at, days, in_future, in_past
from hindcast.operators.spec import LabelSpec


def _aggregate(spec: LabelSpec, cond: Column) -> Column:
    if spec.op in ("exists", "not_exists"):
        return F.max(F.when(cond, 1).otherwise(0))
    if spec.op == "count":
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    if spec.op == "sum":
        return F.sum(F.when(cond, F.col(spec.value)).otherwise(0))
    return F.avg(F.when(cond, F.col(spec.value)))


def events_in_windows(spec: LabelSpec, events: DataFrame, anchors: Sequence[datetime]) -> DataFrame:
    wanted = {spec.link, spec.time, spec.value, spec.filter and spec.filter.column} - {None}
    return in_future(events.select(*sorted(wanted)), spec.time, anchors, spec.horizon_days).where(F.col(spec.link).isNotNull())


def recent_population(spec: LabelSpec, entities: DataFrame, events: DataFrame, anchors: Sequence[datetime]) -> DataFrame:
    """(timestamp, key) of entities with any event in (anchor - lookback, anchor]; the label's filter doesn't apply."""
    past = in_past(events.select(spec.link, spec.time), spec.time, anchors, spec.past_days)
    pairs = past.select("timestamp", F.col(spec.link).alias(spec.entity_key)).distinct()
    return pairs.join(entities.select(spec.entity_key), spec.entity_key, "left_semi")


def population(spec: LabelSpec, entities: DataFrame, events: DataFrame, anchors: Sequence[datetime]) -> DataFrame:
    if spec.population == "recent":
        return recent_population(spec, entities, events, anchors)
    # At most tens of anchors: a row of the entity table is exploded, there is no join.
    from hindcast.operators.anchors import anchor_array

    return entities.select(F.explode(anchor_array(anchors)).alias("timestamp"), spec.entity_key)


def compile_labels(spec: LabelSpec, tables: Mapping[str, DataFrame], anchors: Sequence[datetime]) -> DataFrame:
    spec.checked()
    events, entities = tables[spec.event], tables[spec.entity]
    windows = events_in_windows(spec, events, anchors)
    cond = spec.filter.on() if spec.filter else F.lit(True)
    keys = ["timestamp", spec.entity_key]
    if spec.population == "in_window":
        labels = windows.groupBy("timestamp", F.col(spec.link).alias(spec.entity_key)).agg(_aggregate(spec, cond).alias("target"))
        if spec.op == "mean":
            labels = labels.where(F.col("target").isNotNull())
        return labels.withColumn("target", _above(spec, F.col("target")))
    hits = windows.where(cond).groupBy("timestamp", F.col(spec.link).alias(spec.entity_key)).agg((F.sum(spec.value) if spec.op == "sum" else F.count(F.lit(1))).alias("found"))
    joined = population(spec, entities, events, anchors).join(hits, keys, "left")
    found = F.col("found")
    target = {
        "not_exists": found.isNull().cast("int"),
        "exists": found.isNotNull().cast("int"),
        "count": _above(spec, F.coalesce(found, F.lit(0))),
        "sum": F.coalesce(found, F.lit(0.0)),
    }[spec.op]
    return joined.select(*keys, target.alias("target"))


def _above(spec: LabelSpec, value: Column) -> Column:
    return (value > spec.threshold).cast("int") if spec.op == "count" and spec.threshold is not None else value


def live_population(spec: LabelSpec, entities: DataFrame, events: DataFrame, now: datetime) -> DataFrame:
    """Entity keys to predict for at `now`: everyone, or those with an event in (now - lookback, now] if there are any."""
    everyone = entities.select(spec.entity_key).distinct()
    if spec.population == "all":
        return everyone
    t = F.col(spec.time).cast("timestamp_ntz")
    active = events.where((t > at(now) - days(spec.past_days)) & (t <= at(now)) & F.col(spec.link).isNotNull()).select(F.col(spec.link).alias(spec.entity_key)).distinct()
    nobody = active.limit(1).groupBy().agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return active.unionByName(everyone.join(F.broadcast(nobody), F.lit(True), "left_semi"))


__all__ = ["anchor_table", "compile_labels", "events_in_windows", "live_population", "population", "recent_population"]
