"""Connected components over an edge table, by contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import written


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root) for every node of an edge, the root being one node of its component.

    Each round maps every node to the least of itself and its neighbours (an
    aggregation that combines before the shuffle, so hubs are no hot spot),
    replaces the ends of each edge by that image and drops the loops.  Ids in
    random order shrink by a constant factor a round; the maps are composed at
    the end.  Nodes and edges stay distributed; every round is a written table.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.least("a", "b").alias("m")).unionAll(edges.select(F.col("b").alias("node"), F.least("a", "b").alias("m")))
        least = written(both.groupBy("node").agg(F.min("m").alias("m")).select("node", F.least("node", "m").alias("to")), "least")
        maps.append(least)
        left, right = least.select(F.col("node").alias("a"), F.col("to").alias("x")), least.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].select("node", F.col("to").alias("root"))
    for step in maps[1:]:
        out = out.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out
