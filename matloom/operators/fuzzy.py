"""Neighbour lists as fuzzy sets: a bandwidth for each node, the union of both directions, and places of new points among old ones.

A node's list is as long as the number of neighbours asked for, whatever the number of nodes, so lists travel as arrays, and a batch of them is worked on at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bandwidths(shifted: np.ndarray, target: np.ndarray, rounds: int, tol: float) -> np.ndarray:
    """For each row of distances above the least (padded with infinities) the width at which exp(-d / width) sums up to its target, by bisection."""
    low, high, width = np.zeros(len(shifted)), np.full(len(shifted), np.inf), np.ones(len(shifted))
    open_ = np.ones(len(shifted), bool)
    for _ in range(rounds):
        got = np.exp(-shifted[open_] / width[open_, None]).sum(1)
        off = got - target[open_]
        at = np.flatnonzero(open_)
        far = np.abs(off) >= tol
        open_[at[~far]] = False
        at, off = at[far], off[far]
        if not len(at):
            break
        over = off > 0
        high[at[over]] = width[at[over]]
        low[at[~over]] = width[at[~over]]
        width[at] = np.where(np.isfinite(high[at]), (low[at] + high[at]) / 2, width[at] * 2)
    return width


def smooth_weights(near: DataFrame, rounds: int = 64, tol: float = 1e-5, bandwidth: float = 1.0, alone: int = 1, least_width: float = 1e-3, least: float = 0.0) -> DataFrame:
    """src (a neighbour), dst (the node), weight of neighbour lists (id, nbr, dist): exp of minus the distance beyond the nearest one's over the node's width, which makes the weights of its k neighbours sum up to log2(k + 1).

    A node with `alone` neighbours or fewer weighs them 1. Where many are as near as the nearest, no width is small enough for the sum; it is `least_width` of the mean distance at least. `least` is the least weight.
    """
    lists = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("dist", "nbr"))).alias("l")).select("id", F.col("l.nbr").alias("nbr"), F.col("l.dist").alias("dist"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = np.diff(batch.column(2).offsets.to_numpy())
            d = np.full((len(n), n.max()), np.inf)
            there = np.arange(n.max())[None, :] < n[:, None]
            flat = batch.column(2).flatten().to_numpy()
            d[there] = flat
            shifted = d - d[:, :1]
            width = _bandwidths(shifted, np.log2(n + 1.0), rounds, tol)
            mean = np.where(there, np.where(np.isfinite(d), d, 0), 0).sum(1) / n
            width = np.maximum(width, least_width * mean)
            with np.errstate(invalid="ignore", divide="ignore"):
                w = np.maximum(least, np.exp(-np.maximum(0.0, shifted) / (width * bandwidth)[:, None]))
            w[n <= alone] = 1.0
            yield pa.RecordBatch.from_arrays([batch.column(1).flatten().cast(pa.int64()), pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(w[there])], names=["src", "dst", "weight"])

    return lists.mapInArrow(run, "src long, dst long, weight double")


def fuzzy_union(g: DataFrame) -> DataFrame:
    """src, dst, weight: a + b - a b of an edge's two directions, both ways. One direction alone keeps its weight. Self-loops are left out."""
    turned = g.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    both = g.select("src", "dst", "weight").union(turned).where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("s"), F.max("weight").alias("m"), F.count(F.lit(1)).alias("n"))
    other = F.col("s") - F.col("m")
    return both.select("src", "dst", F.when(F.col("n") > 1, F.col("s") - F.col("m") * other).otherwise(F.col("s")).alias("weight"))


def placed(g: DataFrame, layout: DataFrame) -> DataFrame:
    """id, vec: for each new point (src) of a graph to laid-out ones (dst, weight) the mean of their places (id, vec), weighted; points without weight have no place."""
    far = g.join(layout.select(F.col("id").alias("dst"), F.posexplode("vec").alias("dim", "x")), "dst")
    means = far.groupBy(F.col("src").alias("id"), "dim").agg((F.sum(F.col("weight") * F.col("x")) / F.nullif(F.sum(F.abs("weight")), F.lit(0.0))).alias("x")).where("x IS NOT NULL")
    return means.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("vec"))
