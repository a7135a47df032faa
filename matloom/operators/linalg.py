"""Low-rank decompositions of features x observations, where observations are rows of a table (id, vec).

Every algorithm needs products with the tall matrix only: each is one pass in which tasks add up small
matrices. The small factors (features x k) live on the driver; left with the rows are projections, one pass more.
The matrix here is X (observations x features), the transpose of S, so V of X holds S's left vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matloom.operators.dense import gram, rows_of


def oriented(v: np.ndarray, u: np.ndarray | None = None) -> np.ndarray:
    """Columns with the sign that makes the positive part the heavier one, of v (times that of u, where it is given)."""
    pos, neg = np.linalg.norm(np.maximum(v, 0), axis=0), np.linalg.norm(np.minimum(v, 0), axis=0)
    if u is not None:
        pos, neg = pos * np.linalg.norm(np.maximum(u, 0), axis=0), neg * np.linalg.norm(np.minimum(u, 0), axis=0)
    return v * np.where(pos < neg, -1.0, 1.0)


def gram_schmidt(a: np.ndarray, least: float = 1e-4) -> np.ndarray:
    """Modified Gram-Schmidt; from the first column that all but vanishes on, columns are zero."""
    q = np.array(a, float)
    for j in range(q.shape[1]):
        for i in range(j):
            q[:, j] -= (q[:, i] @ q[:, j]) * q[:, i]
        size = np.linalg.norm(q[:, j])
        if size < least:
            q[:, j:] = 0
            break
        q[:, j] /= size
    return q


def eig_gram(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, in ascending order, and right vectors of a matrix whose Gram matrix is g."""
    w, v = np.linalg.eigh((g + g.T) / 2)
    return np.sqrt(np.maximum(w, 0)), v


def eig_svd(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thin SVD of a tall matrix from the eigenvectors of its Gram matrix, in ascending order."""
    s, v = eig_gram(a.T @ a)
    return a @ v / np.where(s > 0, s, 1.0), s, v


def sum_of(rows: DataFrame, work, width: int) -> np.ndarray:
    """The sum over tasks of what `work` makes of a block of rows, an array for each column: a flat array of `width` numbers, added up in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += work(*map(rows_of, batch.columns)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["sum"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for x in batch.column(0):
                total += x.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["sum"])

    some = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]).mapInArrow(run, "sum array<double>").repartition(8).mapInArrow(add, "sum array<double>")
    return sum((np.array(r[0]) for r in some.collect()), np.zeros(width))


def gram_times(v: DataFrame, q: np.ndarray) -> np.ndarray:
    """XᵀX Q in one pass."""
    return sum_of(v.select("vec"), lambda x: x.T @ (x @ q), q.size).reshape(q.shape)


@dataclass
class Svd:
    """S = left diag(values) rightᵀ: left (features x k) here, right as a projection of each row by left / values. A and B are the low-rank terms added to S so far, B by its products with rows."""

    left: np.ndarray
    values: np.ndarray
    #: How each row x gives its right vector: x @ project + shift.
    project: np.ndarray
    shift: np.ndarray
    a: np.ndarray | None = field(default=None)
    #: How each row x gives its entries of B: x @ b[0] + b[1].
    b: tuple[np.ndarray, np.ndarray] | None = field(default=None)

    def added(self, v: DataFrame) -> DataFrame | None:
        """id, vec: the rows of B, where something has been added to S."""
        return None if self.b is None else Svd(self.left, np.ones(len(self.b[1])), *self.b).right(v)

    def right(self, v: DataFrame, scaled: bool = False, grid: float = 0.0) -> DataFrame:
        """id, vec: right vectors (times the values, if scaled), rounded to a grid."""
        p, c, s = self.project, self.shift, self.values if scaled else np.ones(len(self.values))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    r = rows_of(batch.column(1)) @ p + c
                    r = (np.round(r / grid) * grid if grid else r) * s
                    yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(r.tolist(), pa.list_(pa.float64()))], names=["id", "vec"])

        return v.select("id", "vec").mapInArrow(run, "id long, vec array<double>")


def _from_left(left: np.ndarray, values: np.ndarray) -> Svd:
    left = oriented(left)
    return Svd(left, values, left / np.where(values > 0, values, 1.0), np.zeros(len(values)))


def svd(v: DataFrame, k: int, algorithm: str = "irlb", rounds: int = 0, seed: int = 0, whole: int = 2048) -> Svd:
    """irlb: block Krylov steps on the Gram matrix with full orthogonalisation (the whole Gram matrix up to `whole` features); halko: randomised range finder with orthonormal power steps; feng: the same with oversampling 5 and eigSVD at the end, of the projected matrix through its Gram matrix. Up to a few thousand features."""
    if algorithm not in ("irlb", "halko", "feng"):
        raise ValueError("the algorithm is irlb, halko or feng")
    n, m = v.count(), len(v.select("vec").first()[0])
    k = min(k, m, n)
    rng = np.random.default_rng(seed)
    if algorithm == "irlb":
        if m <= whole:
            values, u = eig_gram(gram(v).products)
            return _from_left(u[:, ::-1][:, :k], values[::-1][:k])
        space = np.linalg.qr(rng.standard_normal((m, min(m, k + 7))))[0]
        blocks = [space]
        for _ in range(min(rounds or 10, -(-m // space.shape[1]))):
            nxt = gram_times(v, blocks[-1])
            for b in blocks:
                nxt -= b @ (b.T @ nxt)
            blocks.append(np.linalg.qr(nxt)[0])
        q = np.linalg.qr(np.concatenate(blocks, 1))[0]
    else:
        extra = 2 if algorithm == "halko" else 5
        q = np.linalg.qr(rng.standard_normal((m, min(m, k + extra))))[0]
        for _ in range(rounds or 5):
            q = np.linalg.qr(gram_times(v, q))[0]
    values, u = eig_gram(q.T @ gram_times(v, q))
    return _from_left(q @ u[:, ::-1][:, :k], values[::-1][:k])


def perturbed(v: DataFrame, old: Svd, a: np.ndarray, project: np.ndarray, shift: np.ndarray) -> Svd:
    """The SVD of U diag(s) Vᵀ + A Bᵀ, where row i of B is x_i @ project + shift: through the core of size k + columns, with sums of one pass."""
    k, c = len(old.values), a.shape[1]
    p, s0 = np.concatenate([old.project, project], 1), np.concatenate([old.shift, shift])
    size = k + c
    both = sum_of(v.select("vec"), lambda x: (y := x @ p + s0).T @ y, size * size).reshape(size, size)
    m, cross = old.left.T @ a, both[:k, k:]
    q1, r1 = np.linalg.qr(a - old.left @ m)
    # B less its part in V, orthonormalised through its Gram matrix.
    rest = both[k:, k:] - cross.T @ cross
    w, e = np.linalg.eigh((rest + rest.T) / 2)
    root = np.sqrt(np.maximum(w, 0))
    inverse = e / np.where(root > 1e-10 * max(root.max(initial=0), 1e-300), root, np.inf)
    core = np.zeros((size, size))
    core[:k, :k] = np.diag(old.values)
    core += np.concatenate([m, r1]) @ np.concatenate([cross, (e * root).T]).T
    u, values, vt = np.linalg.svd(core)
    left = np.concatenate([old.left, q1], 1) @ u[:, :k]
    turn = vt.T[:, :k]
    # Right vectors: V and the orthonormal rest of B, each linear in the row.
    to_v = np.concatenate([np.eye(k), np.zeros((c, k))])
    to_q = np.concatenate([-cross, np.eye(c)]) @ inverse
    mix = to_v @ turn[:k] + to_q @ turn[k:]
    added = (a, (project, shift)) if old.a is None else (np.concatenate([old.a, a], 1), (np.concatenate([old.b[0], project], 1), np.concatenate([old.b[1], shift])))
    flip = np.where((oriented(left) == left).all(0), 1.0, -1.0)
    return Svd(left * flip, values[:k], p @ mix * flip, s0 @ mix * flip, *added)


def _totals(v: DataFrame) -> tuple[int, np.ndarray]:
    width = len(v.select("vec").first()[0])
    got = sum_of(v.select("vec"), lambda x: np.append(x.sum(0), len(x)), width + 1)
    return int(got[-1]), got[:-1]


def deflate(v: DataFrame, old: Svd, a: np.ndarray, project: np.ndarray, shift: np.ndarray) -> Svd:
    """Adds A Bᵀ and takes the mean of every observation away with it: A gets a column of ones, B the negative means."""
    n, m = v.count(), old.left.shape[0]
    ones = np.ones((m, 1))
    means = a.mean(0)
    to_mean = -(project @ means)[:, None] - np.full((m, 1), 1.0 / m)
    return perturbed(v, old, np.concatenate([ones, a], 1), np.concatenate([to_mean, project], 1), np.concatenate([[-(shift @ means)], shift]))


def orthogonalize_batch(v: DataFrame, old: Svd, design: DataFrame) -> Svd:
    """Takes the profiles of batches, sums of observations weighted by the design (id, vec), out of the decomposition."""
    width = len(design.select("vec").first()[0])
    m = old.left.shape[0]
    joined = v.select("id", "vec").join(design.withColumnRenamed("vec", "design"), "id").select("vec", "design")
    return orthogonalize_basal(v, old, sum_of(joined, lambda x, d: x.T @ d, m * width).reshape(m, width))


def orthogonalize_basal(v: DataFrame, old: Svd, basal: np.ndarray) -> Svd:
    """Takes basal profiles (features x few) out of the decomposition."""
    z = gram_schmidt(basal)
    return deflate(v, old, z, -z, np.zeros(z.shape[1]))


@dataclass
class Reduced:
    svd: Svd
    reduced: DataFrame  # id, vec of length k


def reduce_kernel(v: DataFrame, k: int, algorithm: str = "irlb", seed: int = 0, grid: float = 0.01) -> Reduced:
    """The reduced kernel: an SVD with the mean profile and the column means taken out, right vectors rounded to a grid of `grid` / root n (0: not rounded), times the values."""
    first = svd(v, k, algorithm, seed=seed)
    n, total = _totals(v)
    m = first.left.shape[0]
    mu = total / n
    a1 = mu / (np.linalg.norm(mu) or 1.0)
    project = np.stack([-a1, a1.mean() * a1 - np.full(m, 1.0 / m)], 1)
    got = perturbed(v, first, np.stack([a1, np.ones(m)], 1), project, np.zeros(2))
    return Reduced(got, got.right(v, scaled=True, grid=grid / np.sqrt(n)))
