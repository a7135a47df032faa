"""The layout over tables beside the one at hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matloom.operators import layout


def graph(spark, groups: int = 3, size: int = 8):
    """Groups of nodes that are all linked, with one weak link between neighbouring groups."""
    n = groups * size
    inner = [(a, b, 1.0 - 0.05 * abs(a - b)) for a in range(n) for b in range(n) if a != b and a // size == b // size]
    outer = [e for i in range(groups - 1) for a, b in [(i * size, (i + 1) * size)] for e in ((a, b, 0.2), (b, a, 0.2))]
    rng = np.random.default_rng(2)
    start = spark.createDataFrame([(i, rng.standard_normal(3).tolist()) for i in range(n + 1)], "id long, vec array<double>")
    return spark.createDataFrame(inner + outer, "src long, dst long, weight double"), start


def places(df):
    return np.array([r["vec"] for r in df.orderBy("id").collect()])


@pytest.mark.parametrize("method, optimizer", [("umap", "adam"), ("tumap", "sgd"), ("largevis", "adam")])
def test_without_negatives_as_in_one_task(spark, method, optimizer):
    g, start = graph(spark)
    how = {"method": method, "optimizer": optimizer, "epochs": 6, "negatives": 0, "components": 3, "a": 1.3, "b": 0.8}
    one, many = [places(layout.layout(g, start, rounds=r, **how)) for r in (False, True)]
    assert one.shape == many.shape == (25, 3) and np.allclose(one, many, atol=1e-9)
    assert not np.allclose(many[0], places(start)[0]) and np.allclose(many[24], places(start)[24])  # the last node has no edge


def test_an_epoch_with_negatives_in_loops(spark):
    g, start = graph(spark)
    y, seed, pool, negatives = places(start)[:, :2], 3, 7, 4
    away = [r["id"] for r in start.orderBy(F.xxhash64("id", F.lit(seed), F.lit(0)), "id").limit(pool).collect()]
    want = y.copy()
    for src, dst, weight in g.collect():
        if weight < 1.0 * 0.95:  # the heaviest weigh 0.95, and only they act in the only epoch
            continue
        d = y[src] - y[dst]
        want[src] += 2 * np.clip(-2 / (1 + d @ d) * d, -5, 5)
        for j in range(negatives):
            other = away[layout._drawn(np.array([src]), np.array([dst]), seed * 1_000_003, j, pool)[0]]
            if other != src:
                d = y[src] - y[other]
                want[src] += np.clip(2 * 1.5 / ((0.1 + d @ d) * (1 + d @ d)) * d, -5, 5)
    how = {"method": "largevis", "optimizer": "sgd", "epochs": 1, "gamma": 1.5, "rounds": True, "negatives": negatives, "pool": pool}
    got = places(layout.layout(g, start, seed=seed, **how))
    assert np.allclose(got, want) and np.allclose(got, places(layout.layout(g, start, seed=seed, **how)))
    assert not np.allclose(got, places(layout.layout(g, start, seed=4, **how)))


def test_groups_stand_apart(spark):
    """With fifty epochs the layout in one task sets the nearest middles at 3.7 to 5.2 times the distance within, by its seed."""
    g, start = graph(spark)
    got = places(layout.layout(g, start, epochs=50, rounds=True, pool=10, seed=1))
    middles = np.array([got[i * 8 : i * 8 + 8].mean(0) for i in range(3)])
    within = np.mean([np.linalg.norm(got[i * 8 : i * 8 + 8] - middles[i], axis=1).mean() for i in range(3)])
    assert np.isfinite(got).all() and min(np.linalg.norm(middles[i] - middles[j]) for i in range(3) for j in range(i)) > 2 * within


def test_draws_cover_the_pool_evenly():
    a = np.arange(20_000) % 200
    some = layout._drawn(a, np.arange(20_000) // 200 + 7, 5, 1, 16)
    assert np.bincount(some, minlength=16).min() > 1_050 and np.bincount(some, minlength=16).max() < 1_450


def test_rounds_of_nothing_and_what_they_refuse(spark):
    g, start = graph(spark)
    assert layout.layout(g, start.limit(0), epochs=2, rounds=True).count() == 0
    assert np.allclose(places(layout.layout(g.limit(0), start, epochs=2, rounds=True)), places(start)[:, :2])
    for bad in ({"at_once": 3, "optimizer": "sgd"}, {"optimizer": "other"}):
        with pytest.raises(ValueError):
            layout.layout(g, start, rounds=True, **bad)
