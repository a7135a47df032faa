"""Archetypes of several views with shared weights."""

import numpy as np
import pytest

from matloom.operators import convex, views


def table(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>").repartition(3)


@pytest.fixture(scope="module")
def mixtures():
    rng = np.random.default_rng(12)
    h = rng.dirichlet(np.ones(3), 90)
    h[:3] = np.eye(3)
    return h, h @ np.array([[0.0, 0, 1], [4, 0, 1], [0, 4, 1]]), h @ np.array([[5.0, 1], [0, 1], [2, 6]])


def weights(got, name, n, k=3):
    out = np.zeros((n, k))
    for r in got.weights.collect():
        out[r["id"]] = r[name]
    return out


def matched(a, b):
    """The largest difference of two sets of weights, up to the order of archetypes."""
    order = [int(np.argmin(np.abs(b - a[:, [j]]).sum(0))) for j in range(a.shape[1])]
    assert sorted(order) == list(range(a.shape[1]))
    return np.abs(a - b[:, order]).max()


def test_two_separable_views_are_recovered(spark, mixtures):
    h, x, y = mixtures
    rng = np.random.default_rng(1)
    got = views.consensus([table(spark, x + 0.01 * rng.standard_normal(x.shape)), table(spark, y + 0.01 * rng.standard_normal(y.shape))], 3, rounds=4, own_rounds=6)
    shared = weights(got, "shared", 90)
    assert matched(h, shared) < 0.1
    assert np.allclose(shared, (weights(got, "h0", 90) + weights(got, "h1", 90)) / 2)
    assert got.apart < 0.05 and all(r < 1 for r in got.residuals)


def test_equal_views_give_the_fit_of_one(spark, mixtures):
    h, x, _ = mixtures
    got = views.consensus([table(spark, x), table(spark, x)], 3, alpha=[2.0, 1.0], rounds=3, own_rounds=6)
    assert np.allclose(weights(got, "h0", 90), weights(got, "h1", 90), atol=1e-6) and got.apart < 1e-8
    one = convex.archetypes(table(spark, x), x[:3].T, rounds=6)
    assert matched(weights(got, "shared", 90), np.array([r["vec"] for r in one.weights(table(spark, x)).orderBy("id").collect()])) < 0.05
