"""Connected components of a table of links, as rounds of two joins (large star, small star) until all are stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm._shared import discard, stored


def components(links: DataFrame) -> DataFrame:
    """links: a long, b long, a table that costs little to read again. Returns id, component (the smallest id reachable) for every id
    that a link names.

    Each round points larger ids at the smallest known neighbour: first every node's larger neighbours, then its smaller
    ones. Neighbour minima are combined before the shuffle and joined back, so no node's neighbours meet in one row, and
    Spark can split the join of a node with very many. Rounds grow with the logarithm of the longest path. They end as soon as
    every id has one link to an id that has none to a smaller, which one count tells.
    """
    edges, older = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "edges")
        if older is not None:
            discard(older)
        older = edges
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").count():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
