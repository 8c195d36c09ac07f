"""Connected components of a link table by repeated contraction; nothing passes through the driver but counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from docaudit.llm.common import store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node reachable.

    Each round sends every node to the neighbour (or itself) with the smallest seeded hash and rewrites the
    links between the chosen nodes. A star is gone after two rounds, a chain shrinks by a constant factor, so
    rounds grow with the logarithm of the longest chain. The minimum per node is an aggregate with map-side
    combine, and links are rewritten by joins of stored tables, whose hot nodes the adaptive join splits.
    Nulls, loops and repeated links are ignored.
    """
    edges = store(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        seed = len(steps)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = F.min(F.struct(F.xxhash64(F.lit(seed), "b").alias("h"), F.col("b").alias("n")))
        own = F.struct(F.xxhash64(F.lit(seed), "a").alias("h"), F.col("a").alias("n"))
        step = store(
            both.groupBy("a").agg(best.alias("best"))
            .select(F.col("a").alias("node"), F.least("best", own)["n"].alias("to"))
        )
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = store(
            edges.join(left, "a").join(right, "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
    if not steps:
        kind = links.schema[a].dataType.simpleString()
        return links.sparkSession.createDataFrame([], f"node {kind}, component {kind}")

    def follow(found: DataFrame, step: DataFrame) -> DataFrame:
        later = step.select(F.col("node").alias("to"), F.col("to").alias("then"))
        return store(found.join(later, "to", "left").select("node", F.coalesce("then", "to").alias("to")))

    found = reduce(follow, steps[1:], steps[0])
    least = store(found.groupBy("to").agg(F.min("node").alias("component")))
    return store(found.join(least, "to").select("node", "component"))
