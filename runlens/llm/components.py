"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a, b): root is the component's
    smallest node. Large-star and small-star steps in turn until nothing
    changes, each cut off by a checkpoint. Nodes with a null
    end or loops are left out; an empty table gives an empty result."""
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, was = common.checkpointed(e), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = common.checkpointed(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFF))).first()
        if now == was:
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        was = now
