"""Neighbours that are cut where they are found."""

import numpy as np
import pytest

from matloom.operators import knn


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_adaptive_lists_are_cut_before_they_are_written(spark, monkeypatch, metric):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(20, 8)) * 4)[np.arange(1000) % 20] + rng.normal(size=(1000, 8)) * 0.3
    x[990:] = rng.normal(size=(10, 8)) * 9
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>").cache()
    k = knn.breadth(1000)
    written, cut = [], knn.cut

    def counted(df, name="cut", *more):
        got = cut(df, name, *more)
        if name == "near":
            written.append(got.count())
        return got

    monkeypatch.setattr(knn, "cut", counted)
    got = sorted(map(tuple, knn.kept_neighbours(v, k, metric).collect()))
    assert got == sorted(map(tuple, knn.kept(knn.neighbours(v, k, metric), k).select("id", "nbr", "pos", "dist").collect()))
    if metric == "l2":
        assert sum(written) < 1000 * k / 2
