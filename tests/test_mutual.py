"""The mutual adaptive graph without a shuffle of its edges."""

import numpy as np
import pytest

from matloom.operators import knn


@pytest.mark.parametrize("metric", knn.METRICS)
def test_mutual_edges_are_not_shuffled(spark, monkeypatch, metric):
    rng = np.random.default_rng(7)
    x = np.abs(rng.normal(size=(300, 6)))
    # Distances of zero, many equal ones, and rows without any neighbour before the cut.
    x[:20], x[20:60] = x[0], np.eye(6)[np.arange(40) % 6]
    x[290:] *= 40
    if metric == "jsd":
        x /= x.sum(1, keepdims=True)
    v = spark.createDataFrame([(int(i) * 3 - 50, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>").cache()
    got = knn.adaptive(v, metric)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(knn, "ENDS", 0)
    joined = knn.adaptive(v, metric)
    assert "Exchange" in joined._jdf.queryExecution().executedPlan().toString()
    assert len(rows := sorted(map(tuple, got.collect()))) > 300 and rows == sorted(map(tuple, joined.collect()))


def test_no_rows_and_few(spark):
    v = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.4, 0.6]), (3, [0.1, 0.9])], "id long, vec array<double>")
    for n in (0, 1, 2, 3):
        assert knn.adaptive(v.limit(n), "jsd").count() == knn.symmetric(knn.adaptive(v.limit(n), "jsd", directed=True), True).count()


def test_blocks_are_looked_at_in_waves(spark, monkeypatch):
    """Each wave shuffles all other rows for its own blocks only."""
    rng = np.random.default_rng(8)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.normal(size=(1100, 4)))], "id long, vec array<double>").cache()
    k, partitions, cut = 30, [], knn.cut

    def counted(df, name="cut", *more):
        partitions.append(df.rdd.getNumPartitions())
        return cut(df, name, *more)

    whole = sorted(map(tuple, knn.kept_neighbours(v, k, "l2", tops=True).collect()))
    monkeypatch.setattr(knn, "cut", counted)
    monkeypatch.setattr(knn, "WAVE", 0.5)
    assert sorted(map(tuple, knn.kept_neighbours(v, k, "l2", tops=True).collect())) == whole
    assert len(partitions) == 3 and max(partitions) <= 2
