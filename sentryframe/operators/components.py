"""Connected components of an edge table.

Alternating star contraction: each round links a node's larger neighbours, then its smaller
ones, to the smallest label around it.  A round is two aggregations and joins over edges
that shrink toward stars, and the number of rounds grows with the logarithm of the
component size rather than with its diameter.  Each round's edges are written to the
checkpoint folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage_cut import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where(F.col("v") > F.col("u")).join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    return (
        linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(linked.select("u", F.col("m").alias("v")))
        .where(F.col("u") != F.col("v")).distinct()
    )


def connected_components(
    nodes: DataFrame, edges: DataFrame, node: str = "node", left: str = "u", right: str = "v"
) -> DataFrame:
    """``node, component``: the smallest node id of the component each node belongs to."""
    current = cut(
        edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
        .where(F.col("u") != F.col("v")).distinct()
    )
    before = None
    while True:
        current = cut(_small_star(_large_star(current)))
        # The edge set is stable exactly when its content fingerprint is.
        after = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if after == before:
            break
        before = after
    return nodes.select(F.col(node)).distinct().join(
        current.select(F.col("u").alias(node), F.col("v").alias("component")), node, "left"
    ).select(node, F.coalesce("component", F.col(node)).alias("component"))
