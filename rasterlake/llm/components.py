"""Connected components of a table of edges by alternating large and small stars.

Every round is two aggregations and joins; no component is gathered anywhere.
Lineage is cut with checkpoint() in the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.session import enable_checkpoints


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node move to the least node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it move to the least of them. a is the greater end."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    return (
        moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of an edge (columns a, b; any sortable type): root is the least node of its component.

    Ends when a round changes nothing, after a number of rounds about the logarithm of the longest chain.
    """
    enable_checkpoints(edges.sparkSession)
    now = edges.where("a <> b").distinct().checkpoint()
    state = None
    while True:
        now = _small_star(_large_star(now)).checkpoint()
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
