"""Features of entities as they were known at each anchor, from sums over the intervals between anchors.

The anchors, and the beginnings of their recent windows, cut time into intervals. An event belongs to the first cut at or
after it, so it is counted into one partial sum per (entity, interval), combined before the shuffle: no event is repeated for
the anchors that come after it. Running sums over an entity's intervals, at most two a anchor, give what was known at each
cut; a recent window is the difference of two of them. Only times up to and including the anchor are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators.anchors import at


def _interval(t: Column, cuts: Sequence[datetime]) -> Column:
    """The number of the first cut at or after a time."""
    later = F.lit(0)
    for cut in cuts:
        later = later + (t > at(cut)).cast("int")
    return later


def point_in_time(events: DataFrame, link: str, time: str, value: str, anchors: Sequence[datetime], recent_days: int, category: str | None = None) -> DataFrame:
    """timestamp, key, n_events, sum_value, mean_value, min_value, max_value, n_recent, sum_recent, days_since_last[, n_categories].

    Rows exist for entities with any event by the anchor. Recent is (anchor - recent_days, anchor].
    """
    t, v, recent = F.col(time).cast("timestamp_ntz"), F.col(value).cast("double"), timedelta(days=recent_days)
    cuts = sorted({*anchors, *(a - recent for a in anchors)})
    seen = events.where(F.col(link).isNotNull() & (t <= at(max(anchors)))).withColumn("_cut", _interval(t, cuts))
    parts = seen.groupBy(F.col(link).alias("key"), "_cut").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.count(v).alias("m"), F.min(v).alias("low"), F.max(v).alias("high"), F.max(t).alias("last"))
    if category is not None:
        # A category counts from its first event on; that event's interval is one of the entity's.
        first = seen.where(F.col(category).isNotNull()).groupBy(F.col(link).alias("key"), F.col(category).alias("_c")).agg(F.min("_cut").alias("_cut"))
        parts = parts.join(first.groupBy("key", "_cut").agg(F.count(F.lit(1)).alias("c")), ["key", "_cut"], "left")
    else:
        parts = parts.withColumn("c", F.lit(0))
    order = Window.partitionBy("key").orderBy("_cut")  # at most a row for each cut
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0))
    known = parts.select(
        "key", "_cut", F.lead("_cut", 1, len(cuts)).over(order).alias("_next"), zero("n").alias("n"), F.sum("s").over(so_far).alias("s"), zero("m").alias("m"), F.min("low").over(so_far).alias("low"),
        F.max("high").over(so_far).alias("high"), F.max("last").over(so_far).alias("last"), zero("c").alias("c"),
    )
    # What an interval's row knows holds at every cut before the next one's: the anchors' own, and where their recent windows begin.
    uses = F.array(*(F.struct(F.lit(cuts.index(when)).alias("cut"), at(a).alias("timestamp"), F.lit(now).alias("now")) for a in anchors for when, now in ((a, True), (a - recent, False))))
    used = known.withColumn("_use", F.explode(F.filter(uses, lambda x: (x["cut"] >= F.col("_cut")) & (x["cut"] < F.col("_next")))))
    now = F.col("_use.now")
    at_anchor = lambda c: F.max(F.when(now, F.col(c)))
    sign = lambda c: F.sum(F.when(now, F.col(c)).otherwise(-F.col(c)))
    return used.groupBy(F.col("_use.timestamp").alias("timestamp"), "key").agg(
        at_anchor("n").alias("n_events"), at_anchor("s").alias("sum_value"), F.try_divide(at_anchor("s"), at_anchor("m")).alias("mean_value"), at_anchor("low").alias("min_value"), at_anchor("high").alias("max_value"),
        sign("n").alias("n_recent"), F.coalesce(sign("s"), F.lit(0.0)).alias("sum_recent"), F.date_diff("timestamp", at_anchor("last")).alias("days_since_last"), *([at_anchor("c").alias("n_categories")] if category is not None else []),
    )


NUMERIC = ["n_events", "sum_value", "mean_value", "min_value", "max_value", "n_recent", "sum_recent", "days_since_last"]
