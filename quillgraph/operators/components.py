"""Connected components by alternating stars.

Every round replaces the edges by stars: first each node links its larger neighbours to the smallest
node it knows (large star), then its smaller ones (small star).  Chains halve with each round, so
the number of rounds grows with the logarithm of the graph, and no round holds a node's neighbours
in one row: only minima are aggregated, with partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.staging import cut, drop


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    # neighbours that are larger than the node go to the least node of its neighbourhood
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a")
    return kept.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, src: str = "source", dst: str = "target") -> DataFrame:
    """Per node that has an edge: (node, component), the component being its least node.

    Edges with a null end are left out; self-loops keep their node as a component of its own.
    Directions don't matter.  No edges give an empty result.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    loops = ends.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    e = cut(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    last = None
    while True:  # every round but the last changes the stars, and there are finitely many
        before, e = e, cut(_small_star(_large_star(e).distinct()).distinct(), "components")
        drop(before)
        # a fixed point is told by an order-free digest of the edges
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == last or not now[0]:
            break
        last = tuple(now)
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    known = found.unionByName(roots)
    return known.unionByName(loops.join(known, "node", "left_anti"))
