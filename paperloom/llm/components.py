"""Connected components by alternating large and small stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node to the least of them: the larger ones (large) or the others and the node itself."""
    # edges run from the larger node `a` to the smaller `b`
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    joined = both.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return moved.filter("a <> b").distinct()


def connected_components(links: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """``(node, component)`` for every end of ``links`` ``(a, b)``; the component is its least node."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stored(edges, "edges", scratch), None
    while True:
        # every node linked to one smaller node that is itself linked to nothing smaller: stars, nothing moves any more
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("sum")).first()
        if state == before or not state["n"]:
            break
        before = state
        edges = stored(_star(_star(edges, True), False), "edges", scratch)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
