"""Connected components of links, by alternating large-star and small-star steps on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from covermap.llm.common import kept, release


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node reachable over the links, for each node that has one.

    A large star hangs each node's larger neighbours on its smallest one, a small star its smaller
    neighbours; after some rounds, few even for long chains, every component is a star around its smallest node.
    Smallest neighbours are found by aggregation and joined, so that a node with very many neighbours is
    summed up before the shuffle, and split in the join.
    """
    edges = links.where(F.col(left) != F.col(right)).select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct()
    edges = kept(edges)
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.join(lowest, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        large = kept(large)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        new = _state(edges)
        if new == state:
            break
        state = new
        release(links.sparkSession)
    centres = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        centres.select(F.col("v").alias("node"), F.col("v").alias("component")))
