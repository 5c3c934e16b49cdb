"""A live run: the task is moved to the end of the data, refitted on every anchor whose outcome is known by then, and
predicted for the population that the past gives at that moment.

    run = plan_live(spec, events, end)
    predictions = predict_live(run, tables)            # timestamp, key, prediction, n_labels
    highest(predictions, spec.entity_key, 25)

All of it is one plan: labels at past anchors, their means per entity, the live population and the join of both. The anchors
are few and travel as literals; per-entity sums are combined before their shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.operators.anchors import at
from hindcast.operators.features import NUMERIC, point_in_time
from hindcast.operators.labels import compile_labels, live_population
from hindcast.operators.predict import fit_predict
from hindcast.operators.spec import LabelSpec, baseline_anchors, live_manifest, task_manifest
from hindcast.operators.timeline import dense_end

#: Labels' worth of the mean of all that an entity's own mean is pulled to.
WEIGHT = 5.0


@dataclass(frozen=True)
class LiveRun:
    """What a live run is made of: the moment, the anchors to learn from (each horizon over by then) and the moved task."""

    spec: LabelSpec
    now: datetime
    anchors: list[datetime]
    task: dict[str, Any]


def data_end(events: DataFrame, time: str) -> datetime:
    """The last day on which the events are still dense: later rows are stragglers, not a window to predict from."""
    day = dense_end(events, time).first()["end_day"]
    if day is None:
        raise ValueError(f"no event has a {time}")
    return datetime.combine(day, datetime.min.time())


def plan_live(spec: LabelSpec, events: DataFrame, now: datetime | None = None, most: int = 24, task: dict[str, Any] | None = None) -> LiveRun:
    """Anchors a horizon apart, the last a horizon before `now` (the data's end by default), while a horizon of history lies before
    them. ValueError where there is none. task: the backtest's manifest, which the live one repeats at the new times."""
    spec.checked()
    now = now or data_end(events, spec.time)
    first = events.agg(F.min(F.col(spec.time).cast("timestamp_ntz")).alias("first")).first()["first"]
    anchors = baseline_anchors(now, spec.horizon_days, first, most) if first else []
    if not anchors:
        raise ValueError(f"not enough history before {now} for windows of {spec.horizon_days} days")
    step = timedelta(days=spec.horizon_days)
    return LiveRun(spec, now, anchors, live_manifest(task or task_manifest(spec, now - 2 * step, now - step), now, spec.horizon_days))


def training_labels(run: LiveRun, tables: Mapping[str, DataFrame]) -> DataFrame:
    return compile_labels(run.spec, tables, run.anchors)


def predict_live(run: LiveRun, tables: Mapping[str, DataFrame], weight: float = WEIGHT) -> DataFrame:
    """timestamp, key, prediction, n_labels: every entity of the live population with its smoothed mean label.

    The prediction is (sum of own labels + weight * mean of all) / (number of own labels + weight), so an entity without history
    has the mean of all.
    """
    spec, key = run.spec, run.spec.entity_key
    taught = training_labels(run, tables)
    target = F.col("target").cast("double")
    own = taught.groupBy(key).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    mean = own.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))  # one row, from the entities' sums
    who = live_population(spec, tables[spec.entity], tables[spec.event], run.now)
    n = F.coalesce("n", F.lit(0))
    smoothed = (F.coalesce("s", F.lit(0.0)) + weight * F.col("mean")) / (n + weight)
    return who.join(own, key, "left").crossJoin(F.broadcast(mean)).select(at(run.now).alias("timestamp"), key, smoothed.alias("prediction"), n.alias("n_labels"))


def predict_live_linear(run: LiveRun, tables: Mapping[str, DataFrame], value: str, recent_days: int | None = None) -> DataFrame:
    """timestamp, key, prediction of the live population by a linear (binary labels: logistic) model over the events' features as
    they were known at each anchor; entities without any event have features of 0."""
    spec, key = run.spec, run.spec.entity_key
    known = point_in_time(tables[spec.event], spec.link, spec.time, value, [*run.anchors, run.now], recent_days or spec.past_days).withColumnRenamed("key", key)
    who = live_population(spec, tables[spec.entity], tables[spec.event], run.now).withColumn("timestamp", at(run.now))
    keys = ["timestamp", key]
    return fit_predict(training_labels(run, tables).join(known, keys, "left"), who.join(known, keys, "left"), NUMERIC, key, spec.task_type == "binary", trees=False)


def highest(predictions: DataFrame, key: str, k: int) -> DataFrame:
    """The k highest predictions with their rank, ties by key: a top-k, which each task cuts before anything is sent."""
    top = predictions.orderBy(F.desc("prediction"), key).limit(k)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("prediction")).alias("less"), F.col(key), F.col("timestamp")))), lambda x, i: F.struct((i + 1).alias("rank"), x["timestamp"].alias("timestamp"), x[key].alias(key), (-x["less"]).alias("prediction")))
    return top.agg(F.explode(ordered).alias("x")).select("x.*")
