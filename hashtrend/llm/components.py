"""Connected components of an edge table, by alternating stars.

Each round makes every node's larger neighbours point to its smallest neighbour (large star) and then every node's
smaller neighbours and itself point to the smallest of them (small star); the rounds end when the edges no longer
change, and every node then points to the smallest node of its component.  Tables of a round are checkpointed.  The
join sides are plain exchanges, so a hub with very many neighbours is split by Spark's skew handling.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashtrend.llm.groups import checkpoint


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is the smallest node reachable."""
    now = checkpoint(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    )
    before = _fingerprint(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # large star: the larger neighbours of u point to m
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpoint(large)
        # small star: u and its smaller neighbours point to the smallest of them
        least = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = _fingerprint(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within a task: edges (node, smallest node of its component) that connect what the edges (u, v) connect."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[root]
        if np.array_equal(new, root):
            break
        root = new
    keep = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[keep], nodes[root[keep]]
