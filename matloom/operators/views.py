"""Archetypes of the same observations seen in several tables, tied by weights that all views share.

Each view is fitted by itself first, and its archetypes are put in the order of the first view's. Then rounds alternate: the shared weights are the mean of the views', every row's weights in a view are
the ones nearest to its own data and to the shared ones, and each view's archetypes are combined anew from its rows. A round is one written table of rows, one pass for the sums of each view, and a few passes for each
archetype, as in convex.archetypes; no task holds a view.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.operators.convex import Atoms, archetypes, frank_wolfe
from matloom.operators.dense import rows_of
from matloom.operators.linalg import sum_of
from matloom.operators.matching import assign
from matloom.operators.simplex import solve, spa
from matloom.plans.materialize import cut


@dataclass
class Consensus:
    """For each view its archetypes (features x k) and the rows that they are made of; weights as a table of id, shared, and h0, h1, ... of the views."""

    w: list[np.ndarray]
    atoms: list[list[Atoms]]
    weights: DataFrame
    #: The squared residuals of each view, and the weighted squares of what the views differ by from the shared weights.
    residuals: list[float]
    apart: float


def _moments(rows: DataFrame, view: int, m: int, k: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """X H, HᵀH, the squares of X, and of H less the shared weights, of one view."""

    def work(x: np.ndarray, h: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return np.concatenate([(x.T @ h).ravel(), (h.T @ h).ravel(), [(x * x).sum(), ((h - shared) ** 2).sum()]])

    got = sum_of(rows.select(f"x{view}", f"h{view}", "shared"), work, m * k + k * k + 2)
    return got[: m * k].reshape(m, k), got[m * k : -2].reshape(k, k), float(got[-2]), float(got[-1])


def _residual(w: np.ndarray, xh: np.ndarray, hh: np.ndarray, square: float) -> float:
    return max(0.0, square - 2 * (w * xh).sum() + (w.T @ w * hh).sum())


def _order(rows: DataFrame, view: int, k: int) -> list[int]:
    """Which archetype of a view goes with each of the first view's, by the correlations of their weights: k x k sums."""

    def work(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.concatenate([a, b, np.ones((len(a), 1))], 1)
        return (both.T @ both).ravel()

    g = sum_of(rows.select("h0", f"h{view}"), work, (2 * k + 1) ** 2).reshape(2 * k + 1, -1)
    n, total = g[-1, -1], g[-1, :-1]
    c = g[:-1, :-1] - np.outer(total, total) / n
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    with np.errstate(all="ignore"):
        r = np.nan_to_num(c / np.outer(sd, sd))
    return assign(-(1 + r[:k, k:]))


def consensus(views: list[DataFrame], k: int, alpha: list[float] | None = None, weight: float = 1.0, rounds: int = 10, own_rounds: int = 20, tol: float = 1e-6) -> Consensus:
    """k archetypes of each view (id, vec) with shared weights. `alpha` weighs the views (negative ones as 0, then to a sum of one); `weight` is how much agreement counts, in units of the residuals' sum over the disagreement's after the single fits. Observations that a view does not have are left out."""
    share = np.maximum(np.array(alpha if alpha is not None else [1.0] * len(views), float), 0)
    share /= share.sum()
    views = [cut(v.select("id", "vec"), "view") for v in views]
    fits = []
    for v in views:
        picked = [i for i, _ in spa(v, k)]
        start = {r[0]: r[1] for r in v.where(F.col("id").isin(picked)).select("id", "vec").collect()}
        fits.append(archetypes(v, np.array([start[i] for i in picked], float).T, own_rounds, tol))
    rows = None
    for i, (v, fit) in enumerate(zip(views, fits)):
        own = v.withColumnRenamed("vec", f"x{i}").join(fit.weights(v).withColumnRenamed("vec", f"h{i}"), "id")
        rows = own if rows is None else rows.join(own, "id")
    rows = cut(rows, "views")
    k = min(f.w.shape[1] for f in fits)
    w, atoms = [f.w for f in fits], [f.atoms for f in fits]
    for i in range(1, len(views)):
        order = _order(rows, i, k)
        w[i], atoms[i] = w[i][:, order], [atoms[i][j] for j in order]
        rows = rows.withColumn(f"h{i}", F.array(*[F.col(f"h{i}")[j] for j in order]))
    mean = F.array(*[sum((F.lit(float(a)) * F.col(f"h{i}")[j] for i, a in enumerate(share)), F.lit(0.0)) for j in range(k)])
    rows = cut(rows.withColumn("shared", mean), "views")
    sums = [_moments(rows, i, len(x), k) for i, x in enumerate(w)]
    far, apart = sum(_residual(x, *s[:3]) for x, s in zip(w, sums)), float(share @ [s[3] for s in sums])
    tie = weight * far / apart if apart > 1e-12 else weight
    last = np.inf
    for _ in range(rounds):
        rows = cut(_weights(rows, w, np.sqrt(tie * share), mean), "views", rows)
        sums = [_moments(rows, i, len(x), k) for i, x in enumerate(w)]
        for i, (xh, hh, *_rest) in enumerate(sums):
            for j in range(k):
                if hh[j, j] >= 1e-7:
                    target = w[i][:, j] + (xh[:, j] - w[i] @ hh[:, j]) / hh[j, j]
                    atoms[i][j] = frank_wolfe(views[i], target[:, None], start=[atoms[i][j]])[0]
                    w[i][:, j] = atoms[i][j].point()
        residuals = [_residual(x, *s[:3]) for x, s in zip(w, sums)]
        apart = float(share @ [s[3] for s in sums])
        now = sum(residuals) + tie * apart
        if abs(last - now) <= tol * max(now, 1e-300):
            break
        last = now
    return Consensus(w, atoms, rows.select("id", "shared", *[f"h{i}" for i in range(len(views))]), [_residual(x, *s[:3]) for x, s in zip(w, sums)], apart)


def _weights(rows: DataFrame, w: list[np.ndarray], ties: np.ndarray, mean) -> DataFrame:
    """`rows` with every view's weights anew, nearest to its data and, with its tie, to the shared weights so far, and the new shared ones."""
    k = w[0].shape[1]
    stacked = [np.concatenate([x, t * np.eye(k)]) for x, t in zip(w, ties)]
    names = ["id", *[f"x{i}" for i in range(len(w))], *[f"h{i}" for i in range(len(w))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = [s.T @ s for s in stacked]
        for batch in batches:
            if batch.num_rows:
                shared = rows_of(batch.column(len(w) + 1))
                out = [pa.array([solve(s, np.concatenate([x, t * h]), gram=g).tolist() for x, h in zip(rows_of(batch.column(1 + i)), shared)], pa.list_(pa.float64())) for i, (s, g, t) in enumerate(zip(stacked, grams, ties))]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *batch.columns[1 : 1 + len(w)], *out], names=names)

    schema = ", ".join(["id long", *[f"{n} array<double>" for n in names[1:]]])
    return rows.select("id", *names[1 : 1 + len(w)], "shared").mapInArrow(run, schema).withColumn("shared", mean)
