"""Connected components by contraction, in Spark."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of the edges ``a, b``.

    Each round maps a node to one of its neighbours or itself, and the graph to the mapped nodes. Even rounds take the smallest
    node, which folds stars at once; odd rounds take the smallest hash, which shortens long paths by a constant factor. So rounds
    grow with the logarithm of the longest path. Maps and remaining edges are stored tables; nothing is collected.
    """
    left = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        with_self = both.unionByName(left.select("a", F.col("a").alias("b"))).unionByName(left.select(F.col("b").alias("a"), "b"))
        pick = F.min("b") if len(maps) % 2 == 0 else F.min_by("b", F.xxhash64("b", F.lit(len(maps))))
        chosen = stored(with_self.groupBy("a").agg(pick.alias("to")))
        maps.append(chosen)
        moved = (left.join(chosen.withColumnRenamed("to", "to_a"), "a")
                 .join(chosen.select(F.col("a").alias("b"), F.col("to").alias("to_b")), "b").filter("to_a <> to_b"))
        left = stored(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = maps[0].select(F.col("a").alias("node"), F.col("to").alias("label"))
    for later in maps[1:]:
        labels = labels.join(later.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    labels = stored(labels)
    smallest = stored(labels.groupBy("label").agg(F.min("node").alias("component")))  # stored, so that a join on a large component can be split
    return labels.join(smallest, "label").select("node", "component")
