"""Ranks and ROC areas over whole tables without a window over one partition.

Values are counted first; the distinct values are dealt out in ranges, each range is summed, the few range totals give every
range its start, and a running sum inside each range does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values that a range should hold, the most ranges there are, and the values that their bounds are taken from.
HELD, RANGES, SAMPLE = 20_000, 4096, 32_768
#: Bounds are searched in two steps: among each STEP-th, then among those between two of these.
STEP = 64


def _bounds(counts: DataFrame, value: str, sums: tuple[str, ...]) -> DataFrame:
    """One row: the values that cut the distinct values into as many like parts as their number asks for, RANGES at most.

    Both come from the SAMPLE values of smallest hash: where there are more, the largest of these hashes tells how many. So
    they depend on the values alone: however often Spark evaluates them, every row gets the same range. The order names
    all columns, so that this reads the exchange that the ranges themselves are made from, and the rows below are counted once.
    """
    h = F.xxhash64(value)
    some = counts.orderBy(h, value, *sums).limit(SAMPLE).agg(F.array_sort(F.collect_set(value)).alias("_held"), F.count(F.lit(1)).alias("_n"), F.max(h).alias("_last"))
    many = F.when(F.col("_n") < SAMPLE, F.size("_held")).otherwise(F.size("_held") / ((F.col("_last").cast("double") + 2.0**63) / 2.0**64))
    step = F.greatest(F.ceil(F.size("_held") / F.greatest(F.least(F.ceil(many / HELD), F.lit(RANGES)), F.lit(1))), F.lit(1))
    cut = some.select(F.filter("_held", lambda _, i: (i > 0) & (i % step == 0)).alias("_fine"))
    return cut.select("_fine", F.filter("_fine", lambda _, i: i % STEP == 0).alias("_coarse"))


def _range(value: str) -> Column:
    """How many bounds are at most the value."""
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col(value)))
    block = below(F.col("_coarse"))
    return F.when(block > 0, (block - 1) * STEP + below(F.slice("_fine", (block - 1) * STEP + 1, STEP))).otherwise(0)


def running(counts: DataFrame, value: str, *sums: str, by: tuple[str, ...] = ()) -> DataFrame:
    """counts: one row per distinct value (and `by`). Adds <sum>_before: the total of each column over all smaller values."""
    more = tuple(c for c in counts.columns if c != value)
    ranged = counts.crossJoin(F.broadcast(_bounds(counts, value, more))).withColumn("_range", _range(value)).drop("_fine", "_coarse")
    starts = ranged.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    earlier = Window.partitionBy(*by).orderBy("_range")  # at most RANGES rows in each
    starts = starts.select(*by, "_range", *((F.sum(f"_{c}").over(earlier) - F.col(f"_{c}")).alias(f"_{c}_start") for c in sums))
    inside = Window.partitionBy(*by, "_range").orderBy(value)
    summed = ranged.join(starts if by else F.broadcast(starts), [*by, "_range"])
    for c in sums:
        summed = summed.withColumn(f"{c}_before", F.sum(c).over(inside) - F.col(c) + F.col(f"_{c}_start"))
    return summed.drop("_range", *(f"_{c}_start" for c in sums))


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """value, n, rank_min (from 1), rank_avg, percent_rank of each distinct non-null value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return ranked_counts(counts)


def ranked_counts(counts: DataFrame) -> DataFrame:
    """The same from counts: value, n of each distinct value."""
    ranked, total = running(counts, "value", "n"), counts.agg(F.sum("n").alias("total"))
    below = F.col("n_before")
    percent = F.when(F.col("total") > 1, below / (F.col("total") - 1)).otherwise(F.lit(0.0))
    return ranked.join(F.broadcast(total)).select("value", "n", (below + 1).alias("rank_min"), (below + (F.col("n") + 1) / 2).alias("rank_avg"), percent.alias("percent_rank"))


def roc_auc(df: DataFrame, label: str, score: str | Column, *by: str, weight: str | None = None) -> DataFrame:
    """One row (per `by`): auc, null with one class only. Ties count half. weight: how many rows a row stands for."""
    score = F.col(score) if isinstance(score, str) else score
    positive, n = F.col(label).cast("int"), F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    known = df.where(score.isNotNull() & F.col(label).isNotNull())
    counts = known.groupBy(*by, score.alias("_score")).agg(F.sum(positive * n).alias("pos"), F.sum((1 - positive) * n).alias("neg"))
    area = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return running(counts, "_score", "neg", by=by).groupBy(*by).agg(F.try_divide(area, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))
