"""The adaptive graph's weights need no pass over its edges for a row's largest distance."""

import numpy as np
import pytest

from matloom.operators import knn


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_largest_distances_come_with_the_neighbours(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, 4))
    # Distances of zero, and under ip only negative ones beside them.
    x[:30] = x[0]
    x[30:40] = 0
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>").cache()
    k = knn.breadth(120)
    want = {}
    for i, n, p, d in knn.kept(knn.neighbours(v, k, metric), k).select("id", "nbr", "pos", "dist").collect():
        if d != 0:
            want.setdefault(i, {})[n] = d
    want = {(n, i): max(1e-7, max(of.values()) - d) for i, of in want.items() for n, d in of.items()}
    g = knn.adaptive(v, metric, directed=True)
    assert {(r.src, r.dst): r.weight for r in g.collect()} == want
    assert "Window" not in g._jdf.queryExecution().executedPlan().toString()
