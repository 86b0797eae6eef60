"""Connected components of a links table by repeated hooking and contraction; no vertex list leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs to ``(node, root)`` for every node with a link; the root is the same for all of a component.

    Every node hooks to its smallest neighbour, pointers are doubled twice, and the links between the remaining roots go
    into the next round. Self-links, repeated links and either direction are fine.
    """
    edges = materialize(links.filter("a <> b").select("a", "b").distinct(), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy("a").agg(F.min("b").alias("_low")).select(F.col("a").alias("node"), F.least("a", "_low").alias("root")), "hooks")
        for _ in range(2):
            up = up.join(up.select(F.col("node").alias("root"), F.col("root").alias("_next")), "root").select("node", F.col("_next").alias("root"))
        up = materialize(up, "roots")
        if roots is None:
            roots = up
        else:
            moved = up.select(F.col("node").alias("root"), F.col("root").alias("_new"))
            roots = materialize(roots.join(moved, "root", "left").select("node", F.coalesce("_new", "root").alias("root")), "roots")
        left = up.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        right = up.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        edges = materialize(edges.join(left, "a").join(right, "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "links")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
