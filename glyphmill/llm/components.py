"""Connected components, for groups of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.scratch import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the connected component of each node of the edges (a, b), by alternating large and small stars.

    Minima are aggregated before they are shuffled and joined back, so that a node with very many
    neighbours is no single task's.
    """

    def least(of: DataFrame) -> DataFrame:
        return of.groupBy("u").agg(F.min("v").alias("m"))

    edges = scratch.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.filter("v > u").join(least(both), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = scratch.put(large)
        to_least = large.join(least(large), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.put(to_least.unionByName(least(large).withColumnRenamed("m", "v")).distinct())
        mark = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
        same = edges.agg(*mark).first() == after.agg(*mark).first()
        scratch.drop(edges, large)
        edges = after
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
