"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import materialize


def _to_least(adjacent: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours b of each a to the least node around a."""
    least = adjacent.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = adjacent.join(least, "a")
    if larger_only:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))
    )


def components(spark: SparkSession, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the least node that each node of `edges` (a, b: long) can reach.

    Every round links neighbours to their least neighbour (large star, then small star) and is
    written to the shared folder, so the plan stays short. Minima are summed before the shuffle; a
    node with very many neighbours appears as a join key only, which adaptive execution splits.
    An empty edge table gives an empty result.
    """
    now = materialize(spark, edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both, True).where("a != b").distinct()
        small = _to_least(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False)
        now = materialize(spark, small.where("a != b").distinct(), name)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == mark:
            break
        mark = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
