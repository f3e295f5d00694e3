"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import discard, staged


def _large(e: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node it knows."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the least of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the least node of the component.

    Rounds grow with the logarithm of the longest chain; each is cut by a table in the shared folder. The driver sees a count a round,
    and rounds end when one equals the one before, row by row. Edges from a node to itself and null ends are ignored.
    """
    e = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "components-0")
    size = e.count()
    while size:
        before, e = e, staged(_small(_large(e)), "components")
        was, size = size, e.count()
        # both are sets: of one size, they are equal if nothing of one is missing in the other
        done = was == size and e.join(before, ["a", "b"], "left_anti").isEmpty()
        discard(before)
        if done:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
