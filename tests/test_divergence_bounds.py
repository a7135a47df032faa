"""Which divergences are worked out exactly."""

import numpy as np
import pytest

from matloom.operators import knn


@pytest.mark.parametrize("scale", [1.0, 0.6, 3.0])
def test_no_near_row_is_left_out_and_few_others_are_taken(scale):
    rng = np.random.default_rng(3)
    x = rng.gamma(0.4, size=(10, 32))[np.arange(700) % 10] * rng.gamma(20, size=(700, 32))
    x[rng.random(x.shape) < 0.3] = 0
    x *= scale / x.sum(1, keepdims=True)
    a, b = x[:100], x[100:]
    d = np.array([knn.exact(r, b, "jsd") for r in a])
    limit = np.sort(d, 1)[:, 12]
    i, j = knn._nearer_jsd(a, b, limit)
    got = np.zeros(d.shape, bool)
    got[i, j] = True
    assert got[d <= limit[:, None]].all() and len(i) == got.sum() <= (d <= limit[:, None]).sum() + 20


def test_bounds_too_coarse_or_without_roots_are_not_used():
    x = np.full((4, 8), 0.125)
    assert knn._nearer_jsd(x, x, np.zeros(4)) is None
    assert knn._nearer_jsd(x - 0.2, x, np.ones(4)) is None
