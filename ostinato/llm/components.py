"""Connected components by alternating large and small stars, for edge lists of any size.

Hubs don't gather: minima are pre-aggregated, written, and joined back by a plain equi-join that adaptive execution can
split. The driver sees two numbers a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 60
#: Rows of minima (two longs each) that are broadcast at most; more are joined by a shuffle.
SMALL = 1 << 18


def forest(u: np.ndarray, v: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Within a task: labels of places joined by links u-v, beginning with those given: each the least label of its component."""
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not ((nxt := label[label]) == label).all():
            label = nxt


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame, most: int) -> DataFrame:
    """most: how many rows there are at most."""
    m = edges.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
    return F.broadcast(m) if most <= SMALL else m


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _least(both, 2 * n).withColumnRenamed("m", "_m")
    return both.join(m, "u").withColumn("m", F.least("u", "_m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame, n: int) -> DataFrame:
    m = _least(edges, n)
    moved = edges.join(m, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(m.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs -> (node, component), the least node that it reaches; only for nodes with an edge to another.

    Loops and repeats don't matter; rows with a null end are ignored; no edges give an empty table.
    """
    at = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    was = _state(at)
    for _ in range(MAX_ROUNDS):
        if not was[0]:
            break
        large = _large(at, was[0]).checkpoint()
        at = _small(large, large.count()).checkpoint()
        now = _state(at)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
