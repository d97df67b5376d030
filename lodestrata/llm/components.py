"""Connected components of a link table, by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Only minima are aggregated, so
no node's neighbour list is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    sym = _both(edges)
    least = sym.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    return sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("low"))
    moved = down.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(least.select("u", F.col("low").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Node and smallest reachable node, for every node that has a link to another one.

    `edges` holds undirected links of long ids; loops, nulls and repeats are ignored. Columns: node,
    component. An empty table gives an empty one.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        # counted as it is written, so that no further job reads it
        seen = Observation()
        counts = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("sum")
        new = materialize(_small_star(_large_star(now)).observe(seen, *counts))
        discard(now)
        now = new
        if seen.get == mark or not seen.get["n"]:
            break
        mark = seen.get
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
