"""Connected components of a large graph, with every step a grouping or an equi-join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.durable import cut


def local_components(size: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of ``size`` nodes."""
    label = np.arange(size)
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return label
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            nearer = label[label]
            if (nearer == label).all():
                break
            label = nearer


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours move to the smallest node next to ``u``.

    Large: larger neighbours of ``u``.  Small: ``u`` itself and its smaller neighbours.
    """
    if large:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        moved = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)``: each node of a component but its smallest, and that smallest node.

    ``edges`` has the columns ``a`` and ``b``, without nulls.  Alternates large and
    small star steps until nothing moves, ``O(log n)`` rounds in practice; each
    round is written, so a lost executor costs one round.
    """
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        stepped = cut(_star(_star(edges, large=True), large=False))
        same = [
            df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            for df in (edges, stepped)
        ]
        if same[0] == same[1]:
            return stepped
        edges = stepped
