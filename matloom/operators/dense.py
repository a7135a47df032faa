"""Sums over tall dense matrices: each task adds up its own rows, and the small sums meet."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.plans.materialize import cut


def rows_of(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """A list column of equally long vectors as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


#: Columns of a tile of products, and columns up to which all of them may go to the driver.
TILE, MOST = 256, 4096


@dataclass
class Gram:
    """Rows n, column sums, and the products of columns."""

    n: int
    total: np.ndarray
    products: np.ndarray


def _tiles(v: DataFrame) -> DataFrame:
    """i, j, x: the products of the columns of v (vec) in tiles of TILE columns, those on and above the diagonal; a row with i and j -1 holds the number of rows, the columns' sums and their squares' sums.

    Each task adds up its own rows; a tile's sums meet in one task, a tile at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column(0))
                n += len(x)
                total = x.sum(0) if total is None else total + x.sum(0)
                products = x.T @ x if products is None else products + x.T @ x
        if n:
            yield row(-1, -1, np.concatenate([[n], total, np.diag(products)]))
            for i in range(0, len(total), TILE):
                for j in range(i, len(total), TILE):
                    yield row(i // TILE, j // TILE, products[i : i + TILE, j : j + TILE].ravel())

    def row(i: int, j: int, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(np.ascontiguousarray(x, float)))], names=["i", "j", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for i, j, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = x.values.to_numpy()
                if (i, j) == at:
                    total = total + x
                    continue
                if at is not None:
                    yield row(*at, total)
                at, total = (i, j), x
        if at is not None:
            yield row(*at, total)

    schema = "i int, j int, x array<double>"
    return v.select("vec").mapInArrow(run, schema).repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(add, schema)


def gram(v: DataFrame) -> Gram:
    """XᵀX of the vectors (id, vec) on the driver: of `MOST` columns at most, which is checked before anything is added up. sparse.svd needs no products of columns."""
    width = len(v.select("vec").first()[0])
    if width > MOST:
        raise ValueError(f"products of {width} columns are more than the driver takes, which are those of {MOST}")
    rows = {(r["i"], r["j"]): np.array(r["x"]) for r in _tiles(v).collect()}
    head = rows.pop((-1, -1))
    out = np.zeros((width, width))
    for (i, j), x in rows.items():
        tile = x.reshape(-1, min(TILE, width - j * TILE))
        out[i * TILE : i * TILE + len(tile), j * TILE : j * TILE + tile.shape[1]] = tile
        out[j * TILE : j * TILE + tile.shape[1], i * TILE : i * TILE + len(tile)] = tile.T
    return Gram(int(head[0]), head[1 : 1 + width], out)


def correlations(v: DataFrame) -> DataFrame:
    """i, j, r of every pair of columns of the vectors (id, vec), worked out tile by tile where their products have been added up; sums a column are all that the driver sees."""
    tiles = cut(_tiles(v), "tiles")
    head = tiles.where("i < 0").first()
    if head is None:
        return tiles.select("i", "j", F.lit(0.0).alias("r")).limit(0)
    n, (total, square) = head["x"][0], np.array(head["x"][1:]).reshape(2, -1)
    sd = np.sqrt(square - total**2 / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                down, across = np.arange(i * TILE, min(len(total), (i + 1) * TILE)), np.arange(j * TILE, min(len(total), (j + 1) * TILE))
                with np.errstate(all="ignore"):
                    r = (x.values.to_numpy().reshape(len(down), -1) - np.outer(total[down], total[across]) / n) / np.outer(sd[down], sd[across])
                for a, b, values in ((down, across, r), (across, down, r.T))[: 1 if i == j else 2]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a, len(b)), pa.int32()), pa.array(np.tile(b, len(a)), pa.int32()), pa.array(np.ascontiguousarray(values).ravel())], names=["i", "j", "r"])

    return tiles.where("i >= 0").mapInArrow(run, "i int, j int, r double")
