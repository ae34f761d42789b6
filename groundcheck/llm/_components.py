"""Connected components of a distributed edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from groundcheck.llm._shared import join_skewed, materialize


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, for links a-b among nodes 0 to n - 1."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        if np.array_equal(x, y):
            return label
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not np.array_equal(label, up := label[label]):
            label = up


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``, long); a root is its component's smallest node.

    Alternating large-star and small-star rounds, each written to the shared
    folder.  A node's minimum is a partial aggregate, and the links of a node
    with very many are not gathered to meet it (``join_skewed``).  The number of
    rounds grows with the logarithm of the longest chain.  No edges give no rows;
    loops and repeats do no harm.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", light=True)
    mark = None
    while True:
        both = now.union(now.select("b", "a"))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "stars", light=True)
        large = join_skewed(both.where("b > a"), low, ["a"], low).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "edges", light=True)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "stars", light=True)
        small = join_skewed(large, low, ["a"], low).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.union(low.select("a", "m")).distinct(), "edges", light=True)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
