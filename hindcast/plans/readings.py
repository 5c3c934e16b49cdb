"""Shortlists, beams and ranked readings, for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.questions import words_of

KEEP, BEAM, TOP = 0.08, 3, 5


def shortlist(options: DataFrame, k: int) -> DataFrame:
    """options: question_id, question, label, description, position. The k that share the most words; ties by position."""
    shared = F.size(F.array_intersect(words_of(F.col("question")), words_of(F.concat_ws(" ", "label", "description"))))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("shared"), "position"))
    return options.withColumn("shared", shared).withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "label", "shared", "rank")


def beam(answers: DataFrame, keep: float = KEEP, most: int = BEAM) -> DataFrame:
    """answers: question_id, slot, label, p. The likeliest labels of at least `keep`, at most so many, else the best one."""
    rank = F.row_number().over(Window.partitionBy("question_id", "slot").orderBy(F.desc("p"), "label"))
    return answers.withColumn("rank", rank).where(((F.col("p") >= keep) & (F.col("rank") <= most)) | (F.col("rank") == 1))


def average_answers(answers: DataFrame) -> DataFrame:
    """answers: question_id, label, model, p. The mean over models."""
    return answers.groupBy("question_id", "label").agg(F.avg("p").alias("p"))


def candidate_filters(profile: DataFrame, tops: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, column, op, value: equality with top values of few-valued columns, bounds named in the question for numbers."""
    few = profile.where("kind IN ('categorical', 'bool') AND n_distinct <= 30").select("column")
    equal = tops.join(F.broadcast(few), "column").where("rank <= 6").select("column", F.lit("=").alias("op"), "value")
    every = questions.select("question_id").crossJoin(F.broadcast(equal))
    usual = [7, 14, 30, 60, 90, 180, 365]
    named = questions.select("question_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("question", F.lit(r"\b(\d{1,3})\b"), 1), lambda x: x.cast("int")))).alias("n")).where(~F.col("n").isin(usual))
    numeric = profile.where("kind = 'numeric' AND n_distinct <= 60").select("column")
    bounds = named.crossJoin(F.broadcast(numeric)).select("question_id", "column", F.explode(F.array(F.lit("<="), F.lit(">="))).alias("op"), F.col("n").cast("string").alias("value"))
    return every.unionByName(bounds)


def value_columns(profile: DataFrame, links: list[str]) -> DataFrame:
    return profile.where(F.col("kind") == "numeric").where(~F.col("column").isin(links) if links else F.lit(True)).select("column")


def rank_readings(ops: DataFrame, populations: DataFrame, filters: DataFrame, thresholds: DataFrame, top: int = TOP) -> DataFrame:
    """Ranked readings: question_id, op, threshold, filter, population, prob, rank.

    ops: question_id, op, p. populations: question_id, population, p. filters: question_id, filter (null: none), p.
    thresholds: question_id, threshold, lookback (days or null). Joins are on question_id, so a question's few slots multiply
    among themselves only.
    """
    known = ops.withColumnRenamed("p", "p_op").join(thresholds, "question_id", "left")
    above = (F.col("op") == "exists") & F.col("threshold").isNotNull()
    none = F.lit(None).cast("double")
    one = F.struct(F.col("op"), none.alias("threshold"), F.col("p_op").alias("p"))
    split = F.when(above, F.array(F.struct(F.lit("count").alias("op"), F.col("threshold"), (F.col("p_op") * 0.9).alias("p")), F.struct(F.lit("exists").alias("op"), none.alias("threshold"), (F.col("p_op") * 0.1).alias("p")))).otherwise(F.array(one))
    forms = known.select("question_id", "lookback", F.explode(split).alias("form")).select("question_id", "lookback", "form.op", "form.threshold", F.col("form.p").alias("p_op"))
    raised = F.when((F.col("population") == "recent") & ((F.col("op") == "not_exists") | F.col("lookback").isNotNull()), F.greatest("p_pop", F.lit(0.8))).otherwise(F.col("p_pop"))
    rows = forms.join(filters.withColumnRenamed("p", "p_filter"), "question_id").join(populations.withColumnRenamed("p", "p_pop"), "question_id").withColumn("p_pop", raised)
    inside = F.col("population") == "in_window"
    wrong = (inside & ((F.col("op") == "not_exists") | ((F.col("op") == "exists") & F.col("filter").isNull()))) | (~inside & (F.col("op") == "mean"))
    form = Window.partitionBy("question_id", "op", "threshold", "filter", "p_op", "p_filter")
    valid = rows.where(~wrong).withColumn("z", F.sum("p_pop").over(form))
    scored = valid.withColumn("prob", F.col("p_op") * F.col("p_filter") * F.try_divide("p_pop", "z")).where("prob >= 1e-4")
    best = scored.groupBy("question_id", "op", "threshold", "filter", "population").agg(F.max("prob").alias("prob"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.round("prob", 9)), "op", "population", F.coalesce("filter", F.lit("")), F.coalesce("threshold", F.lit(-1.0))))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.withColumn("prob", F.col("prob") / F.sum("prob").over(Window.partitionBy("question_id")))
