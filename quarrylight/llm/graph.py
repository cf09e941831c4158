"""Connected components by contraction, for edges that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import stored


def _ends(to: DataFrame) -> DataFrame:
    """(id, to) with every pointer followed to its end."""
    while True:
        after = to.select(F.col("id").alias("to"), F.col("to").alias("next"))
        doubled = stored(to.join(after, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.coalesce(F.col("next") != F.col("to"), F.lit(False)).alias("moved")))
        to = doubled.select("id", "to")
        if doubled.filter("moved").isEmpty():
            return to


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each end of the edges (a, b), long; component is the smallest id of its component.

    Each round points every vertex to the smallest of itself and its neighbours, follows these pointers to their ends by
    doubling, and contracts the graph to the ends. Those are local minima, at most half of the vertices that have edges, so
    the rounds are logarithmic. Then the pointers are composed from the last round back.
    """
    edges = edges.select("a", "b").filter("a <> b").distinct()
    pointers = []
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("to")))
        if to.isEmpty():
            break
        to = _ends(to)
        pointers.append(to)
        left, right = to.select(F.col("id").alias("a"), F.col("to").alias("ta")), to.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        edges = stored(edges.join(left, "a").join(right, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a <> b").distinct())
    if not pointers:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = pointers.pop().select("id", F.col("to").alias("component"))
    while pointers:
        after = labels.select(F.col("id").alias("to"), "component")
        labels = pointers.pop().join(after, "to", "left").select("id", F.coalesce("component", "to").alias("component"))
    return stored(labels)
