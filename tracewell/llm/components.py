"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut


def _two_steps(pointers: DataFrame) -> DataFrame:
    """(a, to, far): where each pointer leads, and where that one's own leads."""
    return pointers.join(pointers.select(F.col("a").alias("to"), F.col("to").alias("far")), "to")


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) for every id in ``links`` (a, b): the smallest id that is reachable.

    In each round every node points to its smallest neighbour; pointers are
    doubled until all reach the end of their path, and the graph is contracted
    to these ends. Rounds, and doublings in a round, grow with the logarithm of
    the size of a component, also for long chains. Nothing is collected.
    """
    edges = cut(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        down = both.groupBy("a").agg(F.least("a", F.min("b")).alias("to"))
        jump = cut(_two_steps(down))
        while not jump.filter("far != to").isEmpty():
            jump = cut(_two_steps(jump.select("a", F.col("far").alias("to"))))
        if labels is None:
            labels = jump.select(F.col("a").alias("id"), F.col("far").alias("component_id"))
        else:
            moved = jump.select(F.col("a").alias("component_id"), "far")
            labels = cut(
                labels.join(moved, "component_id", "left").select("id", F.coalesce("far", "component_id").alias("component_id"))
            )
        left = jump.select("a", F.col("far").alias("x"))
        right = jump.select(F.col("a").alias("b"), F.col("far").alias("y"))
        edges = cut(
            edges.join(left, "a")
            .join(right, "b")
            .filter("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("a").alias("component_id")).limit(0)
    return labels
