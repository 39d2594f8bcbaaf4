"""Connected components of a distributed list of links, by contraction.

Every round each root hooks to its least neighbour, chains are shortened by
pointer jumping, and the links are carried over to the roots. Rounds and jumps
are logarithmic. All steps are joins and partial aggregates; nothing but counts
reaches the driver. The root of a giant component is a hot key of the joins by
parent; both sides of these are exchanged, so adaptive execution splits them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of ``links`` (a, b); component is the least id reachable."""
    edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), narrow=True)
    labels = None
    while not edges.isEmpty():
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        up = ends.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("p"))
        up = materialize(up, narrow=True)
        moved = True
        while moved:  # two jumps a table
            for _ in range(2):
                up = up.join(up.select(F.col("u").alias("p"), F.col("p").alias("g")), "p").select("u", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved"))
                moved = up
                up = up.select("u", "p")
            jumped = materialize(moved, narrow=True)
            up, moved = jumped.select("u", "p"), not jumped.filter("moved").isEmpty()
        if labels is None:
            labels = up.select(F.col("u").alias("id"), F.col("p").alias("component"))
        else:
            root = up.select(F.col("u").alias("component"), F.col("p").alias("q"))
            labels = materialize(labels.join(root, "component", "left").select("id", F.coalesce("q", "component").alias("component")), narrow=True)
        left, right = (up.select(F.col("u").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        edges = edges.join(left, "a").join(right, "b").filter("pa <> pb")
        edges = materialize(edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), narrow=True)
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
