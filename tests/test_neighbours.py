"""Neighbours from an index, by what they find of the exact ones, and fuzzy weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matloom.operators import fuzzy, knn
from matloom.queries.base import simplex, vectors

WHOLE = "/root/testdata/sf0.1"


def share(want, got):
    a, b = ({(r.id, r.nbr) for r in x.collect()} for x in (want, got))
    return len(a & b) / len(a)


@pytest.mark.parametrize("metric", knn.METRICS)
def test_index_has_the_recall_asked_for(spark, metric):
    """Ten neighbours, and as many as the adaptive graph looks at, of the rows with ids divisible by 20, among all rows."""
    v = (simplex if metric == "jsd" else vectors)(spark, WHOLE)
    some = F.col("id") % 20 == 0
    k = knn.breadth(v.count())
    exact = knn.neighbours(v, k, metric).where(some).cache()
    wide = knn.approximate(v, k, metric).where(some)
    assert share(exact, wide) >= 0.9
    assert share(exact.where("pos <= 10"), knn.approximate(v, 10, metric).where(some)) >= 0.9
    assert share(exact.where("pos <= 10"), knn.descend(v, 10, metric).where(some)) >= 0.9


def test_descent_of_a_hub(spark, monkeypatch):
    """One row is a neighbour of nearly all: those that list it are dealt over many gatherings."""
    monkeypatch.setattr(knn, "AROUND", 32)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 8))
    x[0] = 10 * np.abs(x[0])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    got = knn.descend(v, 5, "ip")
    assert share(knn.neighbours(v, 5, "ip"), got) >= 0.9
    assert all(r.pos <= 5 for r in got.collect())
    assert knn.descend(v.limit(0), 3, "l2").count() == 0


def test_graphs_are_exact_unless_a_recall_is_asked_for(spark):
    v = vectors(spark, "/root/testdata/sf0.001").where("id < 200").cache()
    exact, index = (knn.adaptive(v, "l2", directed=True, recall=r) for r in (None, 1.0))
    assert {tuple(r) for r in exact.select("src", "dst").collect()} == {tuple(r) for r in index.select("src", "dst").collect()}


def test_fuzzy_weights(spark):
    rng = np.random.default_rng(1)
    near = [(i, 100 + j, float(d)) for i in range(30) for j, d in enumerate(np.sort(rng.random(12)))] + [(50, 1, 2.0)]
    near += [(60, j, 1.0) for j in range(8)]  # as near as the nearest: no width
    got = fuzzy.smooth_weights(spark.createDataFrame(near, "id long, nbr long, dist double")).collect()
    sums = {}
    for r in got:
        sums.setdefault(r.dst, []).append(r.weight)
    for i in range(30):
        assert abs(sum(sums[i]) - np.log2(13)) < 1e-4 and max(sums[i]) == 1
    assert sums[50] == [1.0] and sums[60] == [1.0] * 8
    g = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (1, 3, 0.25), (4, 4, 1.0)], "src long, dst long, weight double")
    assert sorted(map(tuple, fuzzy.fuzzy_union(g).collect())) == [(1, 2, 0.75), (1, 3, 0.25), (2, 1, 0.75), (3, 1, 0.25)]


def test_new_points_stand_among_their_neighbours(spark):
    g = spark.createDataFrame([(9, 1, 1.0), (9, 2, 3.0), (8, 1, 0.0), (7, 5, 1.0)], "src long, dst long, weight double")
    layout = spark.createDataFrame([(1, [0.0, 4.0]), (2, [4.0, 0.0])], "id long, vec array<double>")
    assert [tuple(r) for r in fuzzy.placed(g, layout).collect()] == [(9, [3.0, 1.0])]


def test_running_nearest_are_exact_and_look_closely_at_few(monkeypatch):
    """Copies, sparse and empty rows, over several tiles: the same as from all pairs, of which most are only bounded."""
    import numpy as np

    from matloom.operators import knn

    rng = np.random.default_rng(1)
    seen = []
    exact = knn.exact
    monkeypatch.setattr(knn, "exact", lambda a, b, metric: seen.append(np.broadcast(a[..., 0], b[..., 0]).size) or exact(a, b, metric))
    for metric in knn.METRICS:
        x = rng.normal(size=(9000, 16))
        if metric == "jsd":
            x = np.maximum(x, 0)
            x /= np.maximum(x.sum(1, keepdims=True), 1e-9)
            x[50:90] *= 0.5
            x[95] = 0
        x[200:220] = x[0]
        names = rng.permutation(9000).astype(np.int64)
        for k in (1, 60):
            seen.clear()
            best = knn._Best(names[:256], x[:256], k, metric, True)
            for i in range(0, 9000, knn.TILE):
                best.see(names[i : i + knn.TILE], x[i : i + knn.TILE])
            assert sum(seen) < 256 * 9000 / 8
            d, who = best.rows()
            want = knn.nearest(x[:256], names[:256], x, names, k, metric, True)
            assert (who == want[1]).all() and np.allclose(d, want[0], rtol=0, atol=1e-12)
