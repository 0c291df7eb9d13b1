"""Connected components of a graph given as edges, by star contraction over stored edge tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b, any order, repeats allowed): root is the component's least node.

    Edges always point from a larger node to a smaller one. In each round every edge is moved to the least parent of its
    parent, and all parents of a node are tied to the least of them, until every node has one parent that has none. The number
    of rounds grows with the logarithm of a component's diameter. Each round's tables are written to the shared folder, so the
    joins read two stored sides and a hub's rows can be split over tasks.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("p")).distinct(), "edges")
    while True:
        least = stored(now.groupBy("v").agg(F.min("p").alias("m"), F.count(F.lit(1)).alias("n")), "parents")
        up = least.select(F.col("v").alias("p"), F.col("m").alias("_up"))
        moved = stored(now.join(up, "p", "left").select("v", F.coalesce("_up", "p").alias("p"), F.col("_up").isNotNull().alias("moved")), "moved")
        open_ = moved.agg(F.max("moved")).first()[0] or least.agg(F.max("n")).first()[0] not in (None, 1)
        if not open_:
            discard(now), discard(moved)
            return least.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(
                least.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
        lowest = stored(moved.groupBy("v").agg(F.min("p").alias("m")), "lowest")
        tied = moved.join(lowest, "v").filter("p <> m").select(F.col("p").alias("v"), F.col("m").alias("p"))
        after = stored(lowest.select("v", F.col("m").alias("p")).unionByName(tied).distinct(), "edges")
        for old in (now, least, moved, lowest):
            discard(old)
        now = after


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least index in the component of each of 0..n-1 under the links i-j."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (nxt := root[root] != root).any():
            root[nxt] = root[root[nxt]]
    return root
