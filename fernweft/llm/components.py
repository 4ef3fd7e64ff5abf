"""Connected components of an edge table, by alternating star operations.

Large-star links a node's larger neighbours to the least node it knows;
small-star does so for the smaller ones and the node itself. Both keep the
components; alternated, they leave stars around the least nodes after a number
of rounds that grows with the logarithm of the longest path. Each round is
written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fernweft.materialize import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    linked = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return linked.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Least node reachable from each node that has an edge.

    ``edges`` has bigint columns ``a`` and ``b``; direction, repeats and loops
    do not matter, edges with a null end are left out. Returns ``node, root``
    for every node but the roots themselves (a root is no row's ``node``).
    """
    current = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    state = None
    while True:
        n, mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == 0 or (n, mark) == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = (n, mark)
        after = materialize(_small_star(_large_star(current)), "edges")
        release(current)
        current = after
