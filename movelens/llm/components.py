"""Connected components of a table of links, without gathering a component anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from movelens.sources.staging import stage, unstage


def _smaller(edges: DataFrame, both: bool) -> DataFrame:
    """Links every node's neighbours to the smallest node around it: the larger ones (``both``) or the others."""
    a, b = F.col("a"), F.col("b")
    around = edges.select("a", "b")
    if both:
        around = around.unionByName(edges.select(b.alias("a"), a.alias("b")))
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = around.join(least, "a")
    moved = joined.filter(b > a if both else b != F.col("m")).select(F.col("m").alias("b"), b.alias("a"))
    if not both:
        moved = moved.unionByName(least.filter(F.col("m") < a).select(F.col("m").alias("b"), "a"))
    return moved.filter(a > b).select("a", "b").distinct()


def local_roots(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each group of 0 .. n - 1, from pairs within one task."""
    root = np.arange(n)
    a, b = np.concatenate((rows, cols)), np.concatenate((cols, rows))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    if not len(a):
        return root
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    who = a[starts]
    while True:
        new = root.copy()
        new[who] = np.minimum(root[who], np.minimum.reduceat(root[b], starts))
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def components(links: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (the smallest node of its component) for every node with a link.

    Two steps alternate: every node links its larger neighbours to the smallest
    node around it, then its smaller ones. The number of rounds grows with the
    logarithm of a component's diameter. Minima combine before the shuffle; the
    links of one node meet in a join, which adaptive execution may split. Each round is written to the
    shared folder. Null ends and self links are ignored.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(
        F.col("a").isNotNull() & a.isNotNull() & b.isNotNull() & (F.col("a") > F.col("b"))
    ).distinct()
    edges = stage(edges, "links")
    before = None
    for _ in range(rounds):
        last, edges = edges, stage(_smaller(_smaller(edges, True), False), "links")
        unstage(last)
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.count_distinct("b")
        ).first()
        if now == before:
            ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return ends.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
