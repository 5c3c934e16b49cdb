"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups, keep one row of each.

Two texts are equal when they are identical after deleting every space, tab, line feed, vertical tab, form feed and
carriage return. The main path is DataFrame functions alone.

Plan: one aggregation on (128-bit hash, normalised bytes). The hash deals the rows out and orders them; the bytes stand
beside it in the key, so a collision of the hash makes two groups, not one. Copies are combined before the shuffle, so
one text that fills a third of the table sends one row per task. The group's answer then joins back to (doc_id, hashes)
rows of some fifty bytes; no text takes part in that join, and Spark splits a skewed hash there.

Defined results: a null text is an empty one, and empty texts are copies of each other. Of equal texts the row with the
most code points stays, then the smallest doc_id; a null doc_id loses against any other. Rows that repeat a doc_id and
its text are one document: each is returned with the same values, and `distinct_documents` leaves one of them. An empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm._shared import documents


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    docs = documents(df, id_col=id_col, text_col=text_col).select("doc_id", F.char_length("text").alias("n"), normalised(F.col("text")).alias("norm"))
    keyed = docs.withColumn("hash", F.unhex(F.md5(F.col("norm").cast("binary"))))
    groups = (
        keyed.groupBy("hash", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("n", F.bitwise_not("doc_id").alias("inverse"))).alias("best"))
        .select("hash", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "group_size", F.bitwise_not("best.inverse").alias("keep_id"))
    )
    rows = keyed.select("doc_id", "hash", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    return rows.join(groups, ["hash", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def distinct_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows that stay, with all their columns: one for each group of copies."""
    best = exact_dedup(df, id_col, text_col).where("kept")
    best = best.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("text_sha256").alias("_sha")).distinct()
    text, row_id = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    keyed = df.select(F.struct("*").alias("_row"), F.coalesce(row_id, F.lit(0)).alias("_id"), row_id.isNull().alias("_none"), F.sha2(normalised(text).cast("binary"), 256).alias("_sha"), F.char_length(text).alias("_n"))
    kept = keyed.join(best, ["_id", "_none", "_sha"])
    # Rows that repeat an id and its text: the longest, and one of those.
    one = F.row_number().over(Window.partitionBy("_id", "_none", "_sha").orderBy(F.col("_n").desc()))
    return kept.withColumn("_rank", one).where("_rank = 1").select("_row.*")
