"""Truncated decompositions of sparse matrices (row_id, col_id, value), which are only multiplied with vectors.

Implicitly restarted Lanczos bidiagonalisation: two bases, of the rows' and of the columns' space, grow by a product with the matrix each. A basis is a table (id, vec) whose
rows hold the entries of all its vectors for one id, so that products with a basis are sums over its rows, and combinations of its vectors go row by row.
The driver holds the small bidiagonal matrix, and a few coefficients come back from each pass: neither the vectors nor a matrix of the features' products ever does.
Each half step writes one table, from which the next starts, so a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.operators.dense import rows_of
from matloom.plans.materialize import cut

EXTRA = 7
#: A vector shorter than this, beside the largest singular value, is none.
LEAST = 1e-12


def _times(t: DataFrame, x: DataFrame, by: str, to: str) -> DataFrame:
    """id, w: the matrix, or its transpose, times one vector (id, x)."""
    return t.join(x.select(F.col("id").alias(by), "x"), by).groupBy(F.col(to).alias("id")).agg(F.sum(F.col("value") * F.col("x")).alias("w"))


def _dots(rows: DataFrame, width: int) -> np.ndarray:
    """Of rows (vec of `width` numbers, w): the products of each vector of the basis with w, and the square of w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1)
        for batch in batches:
            if batch.num_rows:
                w = batch.column(1).to_numpy()
                if width:
                    total[:width] += rows_of(batch.column(0)).T @ w
                total[width] += w @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1), pa.int32()), pa.array(total)], names=["i", "s"])

    out = np.zeros(width + 1)
    for i, s in rows.select("vec", "w").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s")).collect():
        out[i] = s
    return out


def _rowwise(rows: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """id, vec from (id, vec, w): f of the vectors and w of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column(1)) if len(batch.column(1).flatten()) else np.zeros((batch.num_rows, 0))
                got = f(x, batch.column(2).to_numpy())
                offsets = pa.array(np.arange(len(got) + 1, dtype=np.int32) * got.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(got).ravel()))], names=["id", "vec"])

    return rows.select("id", "vec", "w").mapInArrow(run, "id long, vec array<double>")


class _Basis:
    """The vectors of one side so far, in a written table (id, vec)."""

    def __init__(self, ids: DataFrame, seed: int):
        self.rows = self.step = cut(ids.select("id", F.array().cast("array<double>").alias("vec")), "basis")
        self.width, self.seed, self.size = 0, seed, self.rows.count()

    def last(self) -> DataFrame:
        return self.rows.select("id", F.element_at("vec", -1).alias("x"))

    def random(self) -> DataFrame:
        """id, w: a vector of hashes, another one each time."""
        self.seed += 1
        return self.rows.select("id", (F.xxhash64("id", F.lit(self.seed)) / F.lit(float(1 << 63))).alias("w"))

    def grow(self, w: DataFrame, least: float) -> float:
        """Adds w less its part in the basis, made to have length one, and gives its length; a random vector, and length zero, where next to nothing is left. One table is written, which holds the vector before too."""
        if self.width >= self.size:
            # The basis is the whole space: nothing is left outside of it.
            self.rows, self.width = self.rows.select("id", F.concat("vec", F.array(F.lit(0.0))).alias("vec")), self.width + 1
            return 0.0
        for attempt in range(3):
            joined = self.step = cut(self.rows.join(w, "id", "left").select("id", "vec", F.coalesce("w", F.lit(0.0)).alias("w")), "step", self.step)
            self.rows = joined.select("id", "vec")
            got = _dots(joined, self.width)
            c, whole = got[: self.width], got[self.width]
            size = whole - c @ c
            if size < 0.1 * whole:
                # Most of it has gone: what rounding has left of the basis is taken out again.
                less = _rowwise(joined, lambda x, v, c=c: np.concatenate([x, (v - x @ c)[:, None]], 1))
                got = _dots(less.select(F.slice("vec", 1, self.width).alias("vec"), F.element_at("vec", -1).alias("w")), self.width)
                c, size = c + got[: self.width], got[self.width] - got[: self.width] @ got[: self.width]
            s = float(np.sqrt(max(0.0, size)))
            if s > least:
                break
            w, least = self.random(), 0.0
        self.rows = _rowwise(joined, lambda x, v: np.concatenate([x, ((v - x @ c) / s if s > 0 else 0 * v)[:, None]], 1))
        self.width += 1
        return 0.0 if attempt else s

    def turn(self, m: np.ndarray, keep_last: bool) -> None:
        """The vectors times m; with `keep_last`, the last one stays beside them."""
        k = m.shape[0]
        rows = self.rows.withColumn("w", F.lit(0.0))
        self.rows = self.step = cut(_rowwise(rows, lambda x, _: np.concatenate([x[:, :k] @ m, x[:, -1:]], 1) if keep_last else x[:, :k] @ m), "basis", self.step)
        self.width = m.shape[1] + keep_last


@dataclass
class SparseSvd:
    values: np.ndarray
    left: DataFrame  # id (of a row), vec
    right: DataFrame  # id (of a column), vec
    restarts: int
    #: Lengths of what the matrix, applied to each left vector, leaves beside the right one.
    residuals: np.ndarray


def svd(t: DataFrame, k: int, tol: float = 1e-6, restarts: int = 200, seed: int = 0) -> SparseSvd:
    """The k largest singular triplets, to residuals below `tol` times the largest value. Rows and columns without entries have no rows in the result. Entries that repeat add up."""
    t = cut(t.where("value <> 0").groupBy("row_id", "col_id").agg(F.sum("value").alias("value")), "entries")
    left, right = (_Basis(cut(t.select(F.col(c).alias("id")).distinct(), "ids"), seed + 1000 * i) for i, c in enumerate(("row_id", "col_id")))
    most = min(left.size, right.size)
    if not most:
        raise ValueError("the matrix has no entries")
    k = min(k, most)
    work = min(k + EXTRA, most)
    b = np.zeros((work, work))
    # Within the rows' span from the start, so that a basis of their rank is whole.
    right.grow(_times(t, left.random().withColumnRenamed("w", "x"), "row_id", "col_id"), 0.0)
    j, done, top = 0, 0, 0.0
    while True:
        while True:
            b[j, j] = left.grow(_times(t, right.last(), "col_id", "row_id"), LEAST * max(top, 1e-300))
            top = max(top, float(np.linalg.norm(b, 2)))
            beside = _times(t, left.last(), "row_id", "col_id")
            if j + 1 == work:
                break
            b[j, j + 1] = right.grow(beside, LEAST * max(top, 1e-300))
            j += 1
        u, s, vt = np.linalg.svd(b)
        # What the last product leaves outside of the basis decides on the residuals, and is the next vector.
        rest = right.grow(beside, LEAST * max(top, 1e-300))
        residuals = rest * np.abs(u[-1])
        done += 1
        if (residuals[:k] <= tol * s[0]).all() or done >= restarts or rest == 0.0:
            break
        keep = min(k + int((residuals[:k] <= tol * s[0]).sum()), work - 1)
        right.turn(vt.T[:, :keep], True)
        left.turn(u[:, :keep], False)
        b = np.zeros((work, work))
        b[:keep, :keep] = np.diag(s[:keep])
        b[:keep, keep] = rest * u[-1, :keep]
        j = keep
    right.turn(vt.T[:, :k], False)
    left.turn(u[:, :k], False)
    signs = _signs(left.rows, k)
    flip = lambda rows: _rowwise(rows.withColumn("w", F.lit(0.0)), lambda x, _: x * signs)
    return SparseSvd(s[:k], flip(left.rows), flip(right.rows), done, residuals[:k])


def _signs(rows: DataFrame, k: int) -> np.ndarray:
    """For each vector the sign that makes its positive part the heavier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column(0))
                total += (x * np.abs(x)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(total)], names=["i", "s"])

    out = np.zeros(k)
    for i, s in rows.select("vec").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s")).collect():
        out[i] = s
    return np.where(out < 0, -1.0, 1.0)


def _products(rows: DataFrame, width: int) -> np.ndarray:
    """XᵀX of the few columns of rows (vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column(0))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width), pa.int32()), pa.array(total.ravel())], names=["i", "s"])

    out = np.zeros(width * width)
    for i, x in rows.select("vec").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s")).collect():
        out[i] = x
    return out.reshape(width, width)


def _roots(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R and R's inverse, on the space it spans, of columns whose products are g = RᵀR."""
    w, e = np.linalg.eigh((g + g.T) / 2)
    root = np.sqrt(np.maximum(w, 0))
    return (e * root).T, e / np.where(root > 1e-10 * max(root.max(initial=0), 1e-300), root, np.inf)


@dataclass
class SparseReduced:
    values: np.ndarray
    left: DataFrame  # id of a feature, vec
    reduced: DataFrame  # id of an observation, vec


def reduce_kernel(t: DataFrame, features: DataFrame, observations: DataFrame, k: int, grid: float = 0.01, tol: float = 1e-6, seed: int = 0) -> SparseReduced:
    """The reduced kernel of features x observations: the k largest singular triplets, of which the mean profile and the column means are then taken out, right vectors rounded to a grid of `grid` / root n (0: not rounded), times the values.

    `features` and `observations` (id) are all there are, those without entries too. The two terms taken out have rank one each, so the change is worked out in a core of k + 2.
    """
    first = svd(t, k, tol, seed=seed)
    k = len(first.values)
    m, n = features.count(), observations.count()
    means = t.groupBy(F.col("row_id").alias("id")).agg((F.sum("value") / n).alias("mean"))
    size = float(np.sqrt(means.agg(F.sum(F.col("mean") * F.col("mean"))).first()[0] or 0.0)) or 1.0
    means = cut(means.select("id", (F.col("mean") / size).alias("a")), "profile")
    level = (means.agg(F.sum("a")).first()[0] or 0.0) / m
    zeros = F.array(*[F.lit(0.0)] * k)
    left = features.select("id").join(first.left, "id", "left").join(means, "id", "left")
    left = cut(left.select("id", F.concat(F.coalesce("vec", zeros), F.array(F.coalesce("a", F.lit(0.0)), F.lit(1.0))).alias("vec")), "left")
    own = t.join(means.withColumnRenamed("id", "row_id"), "row_id").groupBy(F.col("col_id").alias("id")).agg(F.sum(F.col("value") * F.col("a")).alias("p"), (F.sum("value") / m).alias("q"))
    right = observations.select("id").join(first.right, "id", "left").join(own, "id", "left").fillna(0.0, ["p", "q"])
    right = cut(right.select("id", F.concat(F.coalesce("vec", zeros), F.array(-F.col("p"), level * F.col("p") - F.col("q"))).alias("vec")), "right")
    of_left, of_right = _products(left, k + 2), _products(right, k + 2)
    m_, cross = of_left[:k, k:], of_right[:k, k:]
    r_left, i_left = _roots(of_left[k:, k:] - m_.T @ m_)
    r_right, i_right = _roots(of_right[k:, k:] - cross.T @ cross)
    core = np.zeros((k + 2, k + 2))
    core[:k, :k] = np.diag(first.values)
    core += np.concatenate([m_, r_left]) @ np.concatenate([cross, r_right]).T
    u, values, vt = np.linalg.svd(core)
    u, v, values = u[:, :k], vt.T[:, :k], values[:k]
    to_left = np.concatenate([u[:k] - m_ @ i_left @ u[k:], i_left @ u[k:]])
    to_right = np.concatenate([v[:k] - cross @ i_right @ v[k:], i_right @ v[k:]])
    turned = cut(_rowwise(left.withColumn("w", F.lit(0.0)), lambda x, _: x @ to_left), "left")
    signs = _signs(turned, k)
    step = grid / np.sqrt(n)

    def scaled(x: np.ndarray, _) -> np.ndarray:
        r = x @ to_right * signs
        return (np.round(r / step) * step if grid else r) * values

    return SparseReduced(values, _rowwise(turned.withColumn("w", F.lit(0.0)), lambda x, _: x * signs), _rowwise(right.withColumn("w", F.lit(0.0)), scaled))
