"""Moments under permutations against numpy, and what is written for them."""

import hashlib

import numpy as np
import pytest

from matloom.operators import stats


def _plain(w, x, what, rounds):
    """Ids are places: z-scored columns, places drawn by hashes, the statistic's unscaled moments."""
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    n = len(x)

    def raw(y):
        gx = ((w @ y) * y).sum(0)
        return (w.sum(0)[:, None] * y * y).sum(0) - gx if what == "geary" else gx

    draws = []
    for perm in range(1, rounds + 1):
        y = np.empty_like(z)
        y[sorted(range(n), key=lambda i: hashlib.md5(f"0:{perm}:{i}".encode()).hexdigest())] = z
        draws.append(raw(y))
    return raw(z), np.mean(draws, 0), np.std(draws, 0, ddof=1)


@pytest.mark.parametrize("what", ["moran", "geary"])
@pytest.mark.parametrize("nodes", [16, 16_384])
def test_moments_equal_numpy_and_no_permuted_rows_are_written(spark, monkeypatch, what, nodes):
    rng = np.random.default_rng(3)
    n, dims, rounds = 90, 5, 6
    x, w = rng.normal(size=(n, dims)), rng.random((n, n)) * (rng.random((n, n)) < 0.1)
    w[:, 7], w[7] = 0, 0
    g = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "src long, dst long, weight double")
    v = spark.createDataFrame([(i, d, float(x[i, d])) for i in range(n) for d in range(dims)], "id long, dim int, value double")
    written, cut = [], stats.cut

    def counted(df, *more):
        got = cut(df, *more)
        written.append(got.count())
        return got

    monkeypatch.setattr(stats, "cut", counted)
    monkeypatch.setattr(stats, "NODES", nodes, raising=False)
    monkeypatch.setattr(stats, "AT_ONCE", 20, raising=False)
    got = {r["dim"]: r for r in stats.permuted(g, v, n, what, rounds).collect()}
    assert max(written) <= n * dims
    raw, mu, sigma = _plain(w, x, what, rounds)
    z = (raw - mu) / sigma * (-1 if what == "geary" else 1)
    assert np.allclose([[got[d]["mu"], got[d]["sigma"], got[d]["z"]] for d in range(dims)], np.stack([mu, sigma, z], 1))


def test_no_edges_give_no_rows(spark):
    g = spark.createDataFrame([], "src long, dst long, weight double")
    v = spark.createDataFrame([(i, 0, float(i)) for i in range(4)], "id long, dim int, value double")
    assert stats.permuted(g, v, 4).collect() == []
