"""Dense regions against a walk over the nodes one by one, and the linear solve against many rounds."""

import random

import numpy as np
import pytest

from matloom.operators import graph


def walked(n, edges, least, eps, order):
    """The clusters by visiting nodes in order and following cores, one by one."""
    heavy = {i: [] for i in range(n)}
    for a, b, w in edges:
        if w > eps and a != b:
            heavy[a].append(b)
    core = {i for i in heavy if len(heavy[i]) >= least}
    label, clusters = dict.fromkeys(range(n), 0), 0
    for v in order:
        if v not in core or label[v]:
            continue
        clusters += 1
        queue = [v]
        label[v] = clusters
        while queue:
            for u in heavy[queue.pop()]:
                if not label[u]:
                    label[u] = clusters
                    if u in core:
                        queue.append(u)
    return label, core


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_regions_equal_the_walk(spark, seed):
    rng, n = random.Random(seed), 62
    one = {(a, b): rng.random() for a in range(n) for b in range(a) if rng.random() < (0 if a > 59 else 0.6 if a // 12 == b // 12 else 0.004)}
    edges = [(a, b, w) for (a, b), w in one.items()] + [(b, a, w) for (a, b), w in one.items()] + [(3, 3, 9.0)]
    scores = [(i, float(rng.randint(0, 9))) for i in range(n)]
    g, nodes = spark.createDataFrame(edges, "src long, dst long, weight double"), spark.range(n).select("id")
    got = graph.dense_regions(g, nodes, 4, 0.5, scores=spark.createDataFrame(scores, "id long, score double")).collect()
    label, core = walked(n, edges, 4, 0.5, sorted(range(n), key=lambda i: (-scores[i][1], i)))
    assert len(got) == n and {r.id: r.label for r in got} == label and {r.id for r in got if r.core} == core
    assert max(label.values()) > 1 and 0 in label.values()


def test_regions_of_a_graph_without_edges(spark):
    g = spark.createDataFrame([], "src long, dst long, weight double")
    assert sorted(map(tuple, graph.dense_regions(g, spark.range(3).select("id")).collect())) == [(i, 0, False) for i in range(3)]


def test_linear_solve_is_the_limit(spark):
    rng, n = np.random.default_rng(0), 30
    w = rng.random((n, n)) * (rng.random((n, n)) < 0.2)
    w[:, 7] = w[7] = 0  # alone
    p = w / np.where(w.sum(0) > 0, w.sum(0), 1)
    x0 = np.zeros((n, 3))
    x0[0, 0], x0[7, 1], x0[3:9, 2] = 2, 1, rng.random(6)
    b = x0 / x0.sum(0)
    want = np.linalg.solve(np.eye(n) - 0.85 * p, 0.15 * b)
    g = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(int(i), int(d), float(x0[i, d])) for i, d in zip(*np.nonzero(x0))], "id long, dim int, value double")
    got = np.zeros((n, 3))
    rows = graph.diffuse_solved(g, spark.range(n).select("id"), seeds).collect()
    for r in rows:
        got[r.id, r.dim] = r.value
    assert len(rows) == 3 * n and np.abs(got - want).max() < 1e-10
    assert np.linalg.norm((got - 0.85 * p @ got) - 0.15 * b) < 1e-10
    with pytest.raises(ValueError):
        graph.diffuse_solved(g, spark.range(n).select("id"), seeds, alpha=1.0)


def test_many_columns_go_in_groups(spark, monkeypatch):
    monkeypatch.setattr(graph, "TOGETHER", 2)
    g = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, weight double")
    x0 = spark.createDataFrame([(i % 3, i, 1.0) for i in range(5)], "id long, dim int, value double")
    got = {(r.id, r.dim): r.value for r in graph.diffuse(g, spark.range(3).select("id"), x0).collect()}
    assert len(got) == 15 and all(abs(got[i, 0] - got[i, 3]) < 1e-12 for i in range(3))
    assert all(abs(sum(got[i, d] for i in range(3)) - 1) < 1e-9 for d in range(5))
    assert graph.diffuse(g, spark.range(3).select("id"), x0.limit(0)).count() == 0
