"""Do two label sets say the same? Both have timestamp, key and target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators.ranks import running
from hindcast.operators.spec import LabelSpec

KEYS = ["timestamp", "key"]
#: Slots of a reading in the order in which a difference is asked about, and what is asked (fixed order of slots).
ASKED = {
    "entity": "Whom or what is the prediction for?", "event": "Which events count?", "op": "What about these events is asked?", "value": "Which amount is meant?",
    "filter": "Which of the events count?", "population": "Who is to get a prediction?", "horizon_days": "How many days ahead?",
}


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select(*KEYS, F.col("target").cast("double").alias("a"), F.lit(1).alias("in_a"))
    right = b.select(*KEYS, F.col("target").cast("double").alias("b"), F.lit(1).alias("in_b"))
    return left.join(right, KEYS, "full_outer")


def coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """n_any, n_both, coverage (1 where both are empty)."""
    both = F.sum(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1).otherwise(0))
    return paired(a, b).agg(F.count(F.lit(1)).alias("n_any"), F.coalesce(both, F.lit(0)).alias("n_both")).withColumn("coverage", F.when(F.col("n_any") == 0, 1.0).otherwise(F.try_divide("n_both", "n_any")))


def binary_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: agreement = share of equal labels among the shared pairs, times coverage."""
    shared = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    sums = paired(a, b).agg(F.count(F.lit(1)).alias("n_any"), F.sum(F.when(shared, 1).otherwise(0)).alias("n_both"), F.sum(F.when(shared & (F.col("a") == F.col("b")), 1).otherwise(0)).alias("n_same"))
    share = F.coalesce(F.try_divide("n_same", "n_both"), F.lit(0.0)) * F.try_divide("n_both", "n_any")
    return sums.select(F.when(F.col("n_any") == 0, 1.0).otherwise(share).alias("agreement"))


def numeric_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rank correlation of the shared pairs, at least 0, times coverage; constant labels agree if they are close.

    Equal pairs of labels are counted first: labels are mostly zeros and small numbers, so what is ranked and correlated are the
    distinct pairs, each with its count as weight. Both sides are ranked at once.
    """
    pairs = paired(a, b)
    shared = pairs.where("in_a IS NOT NULL AND in_b IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    long = shared.select("a", "b", "n", F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("value")) for side in "ab"))).alias("x")).select("a", "b", "n", "x.*")
    ranks = running(long.groupBy("side", "value").agg(F.sum("n").alias("n")), "value", "n", by=("side",)).select("side", "value", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("rank")))
    ranked = long.join(ranks, ["side", "value"]).groupBy("a", "b").agg(F.first("n").alias("n"), of("a").alias("x"), of("b").alias("y"))
    n, x, y = F.col("n").cast("double"), F.col("x"), F.col("y")
    close = F.min(F.abs(F.col("a") - F.col("b")) <= 1e-8 + 1e-5 * F.abs("b"))
    constant = (F.min("a") == F.max("a")) | (F.min("b") == F.max("b"))
    sums = ranked.agg(F.sum("n").alias("n_both"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"), F.sum(n * x * y).alias("xy"), constant.alias("constant"), close.alias("close"))
    less = lambda product, u, v: F.col(product) - F.col(u) * F.col(v) / F.col("n_both")
    rho = F.try_divide(less("xy", "x", "y"), F.sqrt(less("xx", "x", "x")) * F.sqrt(less("yy", "y", "y")))
    value = F.when(F.col("constant"), F.col("close").cast("double")).otherwise(F.greatest(rho, F.lit(0.0)))
    total = pairs.agg(F.count(F.lit(1)).alias("n_any"))
    return sums.crossJoin(F.broadcast(total)).select(F.when(F.col("n_any") == 0, 1.0).when(F.coalesce("n_both", F.lit(0)) == 0, 0.0).otherwise(value * F.col("n_both") / F.col("n_any")).alias("agreement"))


def gold_agreement(gold: DataFrame, ours: DataFrame, binary: bool) -> DataFrame:
    """coverage, label_match, agreement, n_gold, n_ours; keys are compared as text, numbers within 1e-3 of the gold's size."""
    as_text = [df.withColumn("key", F.col("key").cast("string")) for df in (ours, gold)]
    pairs = paired(*as_text)
    shared = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    same = (F.col("a") == F.col("b")) if binary else F.abs(F.col("a") - F.col("b")) <= 1e-3 * F.greatest(F.lit(1.0), F.abs("b"))
    sums = pairs.agg(F.count(F.lit(1)).alias("n_any"), F.sum(F.when(shared, 1).otherwise(0)).alias("n_both"), F.sum(F.when(shared & same, 1).otherwise(0)).alias("n_same"), F.count("in_b").alias("n_gold"), F.count("in_a").alias("n_ours"))
    cover, match = F.coalesce(F.try_divide("n_both", "n_any"), F.lit(0.0)), F.coalesce(F.try_divide("n_same", "n_both"), F.lit(0.0))
    return sums.select(cover.alias("coverage"), match.alias("label_match"), (cover * match).alias("agreement"), "n_gold", "n_ours")


def first_difference(a: LabelSpec, b: LabelSpec) -> str:
    """The first slot, in the order in which a user is asked, that two readings fill differently."""
    return next((slot for slot in ASKED if _slot(a, slot) != _slot(b, slot)), "op")


def _slot(spec: LabelSpec, slot: str):
    return (spec.filter, spec.threshold) if slot == "filter" else getattr(spec, slot)


def clarify(readings: list[tuple[LabelSpec, float]], label_sets: list[DataFrame], rival_share: float = 0.4, same_above: float = 0.85, most: int = 2) -> DataFrame:
    """Rivals of the likeliest reading whose labels differ from its own: reading (its number), prob, agreement, slot, question.

    readings: description and probability, likeliest first; label_sets: timestamp, key, target of each, in the same order. A
    rival is at least rival_share times as likely as the first. Readings of another entity or type of label agree by 0, others
    as binary or numeric labels do; a rival that labels nobody agrees by 0 unless the first does neither. The question asks for
    the first slot in which the likeliest rival differs; there is none, and no row, where all agree by same_above or more.
    """
    session = label_sets[0].sparkSession
    (top, share), found = readings[0], None
    for i, (spec, prob) in enumerate(readings[1:], 1):
        if prob < rival_share * share:
            continue
        if spec.entity != top.entity or spec.task_type != top.task_type:
            one = session.range(1).select(F.lit(0.0).alias("agreement"))
        else:
            one = (binary_agreement if top.task_type == "binary" else numeric_agreement)(label_sets[0], label_sets[i])
        part = one.select(F.lit(i).alias("reading"), F.lit(float(prob)).alias("prob"), "agreement", F.lit(first_difference(top, spec)).alias("differs"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = session.createDataFrame([], "reading int, prob double, agreement double, differs string")
    # One row a reading.
    rivals = found.where(F.col("agreement") < same_above).orderBy("reading").limit(most)
    slot = F.first("differs").over(Window.orderBy("reading"))
    asked = F.create_map(*(F.lit(x) for pair in ASKED.items() for x in pair))
    return rivals.select("reading", "prob", "agreement", slot.alias("slot")).withColumn("question", asked[F.col("slot")])
