"""Connected components by alternating large-star and small-star passes over an edge table.

Each pass is one map-side-combined minimum and one join whose hot side the
adaptive planner may split (both sides come fresh from stored tables). Rounds
grow with the logarithm of a component's diameter, not with its size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import stash_small


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (smallest node reachable) for every node with an edge to another.

    Loops, repeats and edges with nulls do nothing; no edges give no rows.
    """
    ends = edges.where(F.col(a) != F.col(b))
    held = stash_small(ends.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    was, now = None, _mark(held)
    while now != was and now[0]:
        both = held.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(held.select("lo", "hi"))
        least = stash_small(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "large")
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = stash_small(large.distinct(), "edges")
        least = stash_small(large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "k"), "small")
        met = large.join(least, F.col("hi") == F.col("k"))
        small = met.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("k", "m"))
        held = stash_small(small.distinct(), "edges")
        was, now = now, _mark(held)
    return held.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(held.select("lo", "lo").distinct())


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n indexes by the links i[k] - j[k]."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        root = new[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root
