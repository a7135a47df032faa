"""Nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are dealt into a grid of cells: a cell holds one group of queries
and streams one share of the candidates past it, in tiles. Vectors are quantised to int8 with
a scale each; a tile's products of whole numbers (exact in float32 up to 1,040 components, in float64 beyond) give every
inner product to within a bound made of the two quantisation errors. Pairs whose upper bound
reaches the k-th best found so far, or the k-th lower bound in the tile, are computed again in double precision
from the original vectors and go through a heap for each query. No pair that belongs to the result can be lost, so
recall is 1. The heaps of a query's cells, k rows each, are merged by a window.

A cell holds up to `QUERY_ROWS` queries, which it takes in blocks of `BLOCK` against each tile, so that candidates are sent to few cells; the grid makes no more shares of the
candidates than the cluster has use for, so the rows to merge do not grow with the square.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a
null id take no part. Only vectors of one length are compared. Every row with a query's id counts as the query's
own; a query id on several rows stands for the least of their vectors; a candidate id on several
rows is a candidate as often. Ties go to the smaller id. An empty table gives no rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matloom.plans.names import quoted

QUERY_ROWS, BLOCK, TILE = 16_384, 2048, 1024
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(quoted(vector))
    return vectors.select(F.col(quoted(key)).cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0))


class Side:
    """Vectors with their int8 form: codes, scale, norms of the quantised and of the lost part."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.scale = np.abs(x).max(1) / 127.0
        codes = np.rint(x / np.where(self.scale > 0, self.scale, 1.0)[:, None]).astype(np.int8)
        back = codes * self.scale[:, None]
        self.codes = codes.astype(np.float32 if x.shape[1] <= 1040 else np.float64)
        self.kept = np.sqrt((back * back).sum(1))
        self.lost = np.sqrt(((x - back) ** 2).sum(1))
        self.norm = np.sqrt((x * x).sum(1))


class Cell:
    def __init__(self, k: int):
        self.k, self.parts, self.sides = k, [], []
        self.heaps: list[list[tuple[float, int]]] = []

    def add_queries(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.parts.append((ids, x))

    def add_candidates(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not self.parts:
            return
        if not self.sides:
            self.ids, own = np.concatenate([i for i, _ in self.parts]), np.concatenate([v for _, v in self.parts])
            self.sides = [Side(self.ids[i : i + BLOCK], own[i : i + BLOCK]) for i in range(0, len(own), BLOCK)]
            self.heaps = [[] for _ in self.ids]
            self.least = np.full(len(self.heaps), -np.inf)
        for at in range(0, len(ids), TILE):
            c = Side(ids[at : at + TILE], x[at : at + TILE])
            for i, q in enumerate(self.sides):
                self._tile(q, i * BLOCK, c)

    def _tile(self, q: Side, first: int, c: Side) -> None:
        """One block of queries, the first of which is number `first`, against one tile."""
        k, heaps, kept = self.k, self.heaps, self.least[first : first + len(q.ids)]
        with np.errstate(over="ignore", invalid="ignore"):
            near = (q.codes @ c.codes.T) * q.scale[:, None] * c.scale[None, :]
            bound = q.kept[:, None] * c.lost[None, :] + q.lost[:, None] * c.norm[None, :] + 1e-9 * q.norm[:, None] * c.norm[None, :]
            top, low = near + bound, near - bound
        top[np.isnan(top)], low[np.isnan(low)] = np.inf, -np.inf
        own = q.ids[:, None] == c.ids[None, :]
        top[own] = low[own] = -np.inf
        least = kept
        if len(c.ids) >= k:
            least = np.maximum(least, np.partition(low, len(c.ids) - k, axis=1)[:, len(c.ids) - k])
        rows, cols = np.nonzero((top >= least[:, None]) & ~own)
        for at in range(0, len(rows), 100_000):
            r, j = rows[at : at + 100_000], cols[at : at + 100_000]
            with np.errstate(over="ignore", invalid="ignore"):
                score = (q.x[r] * c.x[j]).sum(1)
            score[np.isnan(score)] = -np.inf
            for i, s, name in zip((r + first).tolist(), score.tolist(), c.ids[j].tolist()):
                heap = heaps[i]
                if len(heap) < k:
                    heapq.heappush(heap, (s, -name))
                elif (s, -name) > heap[0]:
                    heapq.heapreplace(heap, (s, -name))
        for i in set(rows.tolist()):
            if len(heaps[first + i]) == k:
                kept[i] = heaps[first + i][0][0]

    def found(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.heaps), 512):
            rows = [(i, -n, s) for i, h in zip(self.ids[at : at + 512].tolist(), self.heaps[at : at + 512]) for s, n in h]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=FOUND.names)


def search(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k candidates with the largest inner product, from frames as clean() gives them."""
    spark = candidates.sparkSession
    n_queries, n_rows = queries.count(), candidates.count()
    groups = max(1, math.ceil(n_queries / QUERY_ROWS))
    shares = max(1, min(math.ceil(n_rows / (4 * TILE)), math.ceil(2 * spark.sparkContext.defaultParallelism / groups)))
    least = queries.groupBy("id").agg(F.min("vec").alias("vec"))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = least.select(F.lit(0).alias("side"), dealt(groups).alias("grp"), every(shares).alias("share"), "id", "vec")
    c = candidates.select(F.lit(1).alias("side"), every(groups).alias("grp"), dealt(shares).alias("share"), "id", "vec")
    cells = q.union(c).withColumn("dim", F.size("vec")).repartition(groups * shares, "dim", "grp", "share").sortWithinPartitions("dim", "grp", "share", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, Cell(k)
        for batch in batches:
            place = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)  # dim, grp, share, side
            ids = batch.column(4).to_numpy()
            starts = [0, *(np.nonzero((place[1:] != place[:-1]).any(1))[0] + 1).tolist(), len(place)]
            for a, b in zip(starts, starts[1:]):
                here = tuple(place[a, :3].tolist())
                if here != at:
                    yield from cell.found()
                    at, cell = here, Cell(k)
                x = batch.column(5).slice(a, b - a).flatten().to_numpy().astype(np.float64).reshape(b - a, here[0])
                (cell.add_candidates if place[a, 3] else cell.add_queries)(ids[a:b], x)
        yield from cell.found()

    best = cells.select("dim", "grp", "share", "side", "id", "vec").mapInArrow(run, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def among(vectors: DataFrame, key: str, vector: str, k: int, every: int) -> DataFrame:
    """Neighbours, among all rows, of each row whose id is divisible by `every`."""
    rows = clean(vectors, key, vector)
    return search(rows.where(F.col("id") % every == 0), rows, k)


#: The same rows in DuckDB; a query id on several rows stands for the least of their vectors.
NEAREST_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM (SELECT vec_id, min(e) AS e FROM v GROUP BY vec_id) q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
