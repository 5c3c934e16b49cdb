"""A corpus pipeline of five operators; each stage works on all that the one before it kept.

Defined results, of every stage but the last: all columns stay, whatever their names, and rows stay as they are but for what the
stage decides. A null text counts as empty, and is written as empty by the stage that rewrites texts; a row without doc_id is judged
by its text alone and never dropped for being near to another. Rows that repeat are judged alike: copies of a row go in exact
dedup, which keeps one; ids that still repeat, with other texts, stay or go together. Of equal texts the longest stays, then the
smallest doc_id; of near ones the smallest doc_id. An empty table gives an empty table. The last stage packs every row that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import exact_dedup, ngram_join, packing, substring_dedup, toxicity
from hindcast.llm._shared import crc_mod, prepare, stored, table
from hindcast.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the operator predicts toxic go; it learns from the same labels as its query does."""
    prepare(spark)
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"), lambda doc_id: crc_mod(doc_id, 4) != 2)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays, then the smallest doc_id."""
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal 5-grams, the one of smallest doc_id stays."""
    prepare(spark)
    return ngram_join.one_per_component(docs, n=5, percent=75)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that start earlier go from the texts; every document stays, n_chars follows its text."""
    prepare(spark)
    more = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = substring_dedup.substring_dedup(docs, window=20, carry=more or ["doc_id"])
    values = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return found.select(*(values.get(c, F.col(f"carried.{c}")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in token sequences of 1024."""
    prepare(spark)
    return packing.packed_documents(docs, vocabulary("byte_bpe_50k.json"), end=2, capacity=1024, with_ids=False)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("substring dedup", drop_repeated_passages), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs


#: SQL can't express the stages that learn, link, or pack; tests hold them against brute force.
ORACLE_SQL = None
