"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matloom.plans.materialize import cut

EDGES = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
#: Nodes that a task joins at once.
FLUSH = 500_000


class Forest:
    """Union-find whose roots are the least members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x], x = r, p
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def contract(edges: DataFrame) -> DataFrame:
    """The edges of each task as stars around the least node of each of their components, about FLUSH edges at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def stars() -> pa.RecordBatch:
            rows = [(x, r) for x in forest.up if (r := forest.root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=EDGES.names)

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if a != b:
                    forest.join(a, b)
            if len(forest.up) > 2 * FLUSH:
                yield stars()
                forest = Forest()
        yield stars()

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, EDGES)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its least node) for every node of `edges` (u, v).

    Each task contracts its own edges first. If what is left fits one task, that one joins them; else large stars and
    small stars alternate until nothing changes, each round from written tables.
    """
    now = cut(contract(edges), name)
    few = now.limit(FLUSH + 1).count() <= FLUSH
    if few:
        now = cut(contract(now.coalesce(1)), name, now)
    mark = None
    while not few:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = cut(small, name, now)
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark or not seen[0]:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
