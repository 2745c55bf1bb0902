"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.llm.frames import settle


def _mark(edges: DataFrame) -> tuple:
    """A count and order-independent hash sums: two rounds with equal marks have equal edges."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge to another one; root is the smallest node of its component.

    `edges` has two columns of one orderable type; direction, repeats, loops and nulls do not matter. Minima are aggregated before any
    shuffle, so that a hub costs no more than its own edges, and every round is written to the shared checkpoint folder. An empty
    input gives an empty output.
    """
    a, b = edges.columns
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = settle(pairs)
    mark = _mark(pairs)
    while mark[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        previous, mark = mark, _mark(pairs)
        if mark == previous:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
