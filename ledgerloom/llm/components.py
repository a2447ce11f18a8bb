"""Connected components over an edge table, by alternating large-star and small-star steps.

Every step is an aggregation with map-side combining and an equi-join, so a component of any size, and a node of
any degree, is spread over tasks; nothing is collected. Each step's tables are written to the shared folder: a join of two written tables is one
that adaptive execution can split where a key is hot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import discard, materialize


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the edges a[i]-b[i], in memory."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        old = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == old).all():
            return node, node[label]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) with root the smallest node of the component, for every node that has an edge.

    edges: columns a and b (long). Self-loops, repeated and reversed edges and rows with a null don't matter. An
    empty table gives an empty one.
    """
    edge = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edge = materialize(edge)
    seen = None
    for _ in range(max_rounds):
        both = edge.union(edge.select("b", "a")).toDF("u", "v")
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct())
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        for x in (edge, low, large, least):
            discard(x)
        edge = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"connected components: no end after {max_rounds} rounds")
    return edge.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edge.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
