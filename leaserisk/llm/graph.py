"""Connected components of an edge list, as joins and minimum aggregates.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond").  A hub with very many neighbours is one
row of minima on one side of a join, so Spark may split its other side; no
neighbour list is collected.  Each round is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaserisk.session import checkpoint_dir


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is its component's smallest node.

    Null ends and self loops are dropped; an empty list gives an empty result.
    """
    checkpoint_dir(edges.sparkSession)
    clean = edges.filter(F.col("a") != F.col("b"))
    now = clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (both.join(least, "u").filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = small.filter("a > b").distinct().checkpoint()
        # An edge list is known by its size and two order-free sums.
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003),
                             F.bit_xor(F.xxhash64("b", "a"))).first())
        if sign == before:
            break
        before = sign
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", "b").distinct())
