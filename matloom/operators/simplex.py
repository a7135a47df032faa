"""Convex combinations: regression on the simplex, successive projections and archetypal analysis."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matloom.operators.dense import rows_of

RIDGE = 1e-10


def solve(a: np.ndarray, b: np.ndarray, tol: float = 1e-9, gram: np.ndarray | None = None) -> np.ndarray:
    """x >= 0 with sum 1 that minimises |a x - b|: an active set that starts at the best vertex. Works with columns of `a` by the thousand, as only passive ones enter a system; `gram` is aᵀa, where it is at hand."""
    n = a.shape[1]
    col = (a * a).sum(0) if gram is None else np.diag(gram)
    c = a.T @ b
    first = int(np.argmin(0.5 * col - c))
    passive, x = [first], np.zeros(n)
    x[first] = 1.0
    scale = max(1.0, float(np.abs(c).max()))
    for _ in range(100 * min(n, 200)):
        while True:
            p = np.array(passive)
            g = gram[np.ix_(p, p)] if gram is not None else a[:, p].T @ a[:, p]
            k = np.zeros((len(p) + 1, len(p) + 1))
            k[:-1, :-1] = g + RIDGE * np.eye(len(p))
            k[-1, :-1] = k[:-1, -1] = 1
            z = np.linalg.lstsq(k, np.append(c[p], 1.0), rcond=None)[0][:-1] if len(p) > a.shape[0] + 1 else np.linalg.solve(k, np.append(c[p], 1.0))[:-1]
            if (z > -1e-12).all():
                x[:] = 0
                x[p] = np.maximum(z, 0)
                break
            now, bad = x[p], z <= -1e-12
            step = np.min(now[bad] / (now[bad] - z[bad]))
            moved = now + step * (z - now)
            moved[bad & (np.abs(moved) < 1e-14)] = 0
            x[p] = np.maximum(moved, 0)
            passive = [int(i) for i in p if x[i] > 1e-14] or [int(p[np.argmax(now)])]
            if len(passive) == len(p):
                passive.remove(int(p[np.argmin(moved)]))
        grad = (gram @ x if gram is not None else a.T @ (a @ x)) - c
        level = grad[passive].mean()
        j = int(np.argmin(grad))
        if grad[j] >= level - tol * scale or j in passive:
            break
        passive.append(j)
    x = np.clip(x, 0, 1)
    return x / x.sum()


def solve_many(a: np.ndarray, bs: np.ndarray, tol: float = 1e-9, gram: np.ndarray | None = None) -> np.ndarray:
    """solve() for each row of bs, as rows: all take their steps together, and those with the same passive set share one system."""
    n, k = len(bs), a.shape[1]
    gram = a.T @ a if gram is None else gram
    c = bs @ a
    x, passive = np.zeros((n, k)), np.zeros((n, k), bool)
    first = (0.5 * np.diag(gram) - c).argmin(1)
    x[np.arange(n), first] = 1.0
    passive[np.arange(n), first] = True
    scale = np.maximum(1.0, np.abs(c).max(1, initial=0))
    left = np.arange(n)
    for _ in range(100 * min(k, 200)):
        todo = left
        while len(todo):
            packed = np.ascontiguousarray(np.packbits(passive[todo], axis=1))
            _, own = np.unique(packed.view(f"V{packed.shape[1]}").ravel(), return_inverse=True)
            order = np.argsort(own, kind="stable")
            again = []
            for rows in np.split(todo[order], np.flatnonzero(np.diff(own[order])) + 1):
                p = np.flatnonzero(passive[rows[0]])
                system = np.ones((len(p) + 1, len(p) + 1))
                system[:-1, :-1] = gram[np.ix_(p, p)] + RIDGE * np.eye(len(p))
                system[-1, -1] = 0
                right = np.concatenate([c[np.ix_(rows, p)], np.ones((len(rows), 1))], 1).T
                z = (np.linalg.lstsq(system, right, rcond=None)[0] if len(p) > a.shape[0] + 1 else np.linalg.solve(system, right))[:-1].T
                bad = z <= -1e-12
                fits = ~bad.any(1)
                x[rows[fits]] = 0
                x[np.ix_(rows[fits], p)] = np.maximum(z[fits], 0)
                if fits.all():
                    continue
                rows, z, bad = rows[~fits], z[~fits], bad[~fits]
                now = x[np.ix_(rows, p)]
                step = np.where(bad, now / np.where(bad, now - z, 1.0), np.inf).min(1)
                moved = now + step[:, None] * (z - now)
                moved[bad & (np.abs(moved) < 1e-14)] = 0
                x[np.ix_(rows, p)] = np.maximum(moved, 0)
                keep = moved > 1e-14
                empty = np.flatnonzero(~keep.any(1))
                keep[empty, now[empty].argmax(1)] = True
                same = np.flatnonzero(keep.all(1))
                keep[same, moved[same].argmin(1)] = False
                passive[np.ix_(rows, p)] = keep
                again.append(rows)
            todo = np.concatenate(again) if again else left[:0]
        grad = x[left] @ gram - c[left]
        level = np.where(passive[left], grad, 0).sum(1) / passive[left].sum(1)
        j = grad.argmin(1)
        at = np.arange(len(left))
        go = (grad[at, j] < level - tol * scale[left]) & ~passive[left, j]
        left, j = left[go], j[go]
        if not len(left):
            break
        passive[left, j] = True
    x = np.clip(x, 0, 1)
    return x / x.sum(1, keepdims=True)


def regression(v: DataFrame, w: np.ndarray) -> DataFrame:
    """id, vec: the weights, on the simplex, with which the columns of w (features x p) come nearest to each row (id, vec)."""
    g = w.T @ w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = solve_many(w, rows_of(batch.column(1)), gram=g)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "vec"])

    return v.select("id", "vec").mapInArrow(run, "id long, vec array<double>")


def spa(v: DataFrame, k: int) -> list[tuple[int, float]]:
    """Successive projections: up to k (id, residual norm), each the row farthest from the span of those before. One pass a pick; each task sends its best row."""
    basis: list[np.ndarray] = []
    picked: list[tuple[int, float]] = []
    for _ in range(k):

        def best(batches: Iterator[pa.RecordBatch], basis=tuple(basis)) -> Iterator[pa.RecordBatch]:
            top = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, ids = rows_of(batch.column(1)), batch.column(0).to_pylist()
                r = x.copy()
                # Row by row: a product of matrices may round equal rows differently.
                for b in basis:
                    r -= (r * b).sum(1)[:, None] * b
                size = (r * r).sum(1)
                for i in np.flatnonzero(size >= size.max() * (1 - 1e-15)):
                    # Ties: the longer row, then the smaller id.
                    key = (float(size[i]), float((x[i] ** 2).sum()), -ids[i])
                    if top is None or key > top[0]:
                        top = (key, x[i].tolist(), r[i].tolist())
            if top:
                (size, length, name), x, r = top
                yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([length]), pa.array([-name], pa.int64()), pa.array([r])], names=["size", "length", "id", "r"])

        found = v.select("id", "vec").mapInArrow(best, "size double, length double, id long, r array<double>").collect()
        if not found:
            break
        top = max(found, key=lambda t: (t["size"], t["length"], -t["id"]))
        if top["size"] <= 0:
            break
        picked.append((top["id"], float(np.sqrt(top["size"]))))
        r = np.array(top["r"])
        for b in basis:
            r -= (b @ r) * b
        basis.append(r / np.linalg.norm(r))
    return picked


def spa_local(x: np.ndarray, k: int) -> tuple[list[int], list[float]]:
    """The same for the columns of a small matrix."""
    r, order, sizes = np.array(x, float), [], []
    length = (x * x).sum(0)
    for _ in range(min(k, x.shape[1])):
        size = (r * r).sum(0)
        top = size.max()
        if top <= 1e-20:
            break
        near = np.flatnonzero(size >= top * (1 - 1e-16))
        i = int(near[np.argmax(length[near])])
        order.append(i)
        sizes.append(float(np.sqrt(top)))
        u = r[:, i] / np.sqrt(top)
        r -= np.outer(u, u @ r)
    return order, sizes


@dataclass
class Archetypes:
    c: np.ndarray  # n x k
    h: np.ndarray  # k x n


def aa(a: np.ndarray, w: np.ndarray, rounds: int = 100, tol: float = 1e-6) -> Archetypes:
    """Archetypal analysis of the columns of a (features x n) from archetypes w: weights by regression, then each archetype by regression of its residual target on the data, until the residual hardly changes."""
    n, k = a.shape[1], w.shape[1]
    w, c, last = np.array(w, float), np.zeros((n, k)), np.inf
    for _ in range(rounds):
        g = w.T @ w
        h = solve_many(w, a.T, gram=g).T
        rest = a - w @ h
        for i in range(k):
            size = h[i] @ h[i]
            if size < 1e-7:
                j = int(np.argmax((rest * rest).sum(0)))
                c[:, i] = 0
                c[j, i] = 1
                new = a[:, j]
            else:
                c[:, i] = solve(a, w[:, i] + rest @ h[i] / size)
                new = a @ c[:, i]
            rest += np.outer(w[:, i] - new, h[i])
            w[:, i] = new
        now = np.linalg.norm(rest)
        if abs(last - now) / max(last if np.isfinite(last) else now, 1e-300) < tol:
            break
        last = now
    g = w.T @ w
    h = solve_many(w, a.T, gram=g).T
    return Archetypes(np.clip(c, 0, 1), h)
