"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for each node that an edge names; edges: columns a, b.

    Each round hangs every node's larger neighbours on its least neighbour, then the smaller ones (large star, small
    star); the rounds needed grow with the logarithm of the number of nodes. A round is two grouped minima and two
    joins on the grouped key; minima are taken map-side first and the joins can be split where a node has very many
    neighbours. Each round is written to the shared folder, so lineage does not grow. The last round is the one that
    leaves every edge as it was. Edge cases: loops and repeated edges count once or not at all; nulls are no nodes; an
    empty table gives none.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    n = now.count()
    while n:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        n, before = after.count(), n
        stands = n == before and after.join(now, ["u", "v"], "left_anti").isEmpty()
        drop(now)
        now = after
        if stands:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
