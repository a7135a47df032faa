"""The tree of mutual reachability: its edges, ties among them, and how many rows are held against all others."""

import numpy as np

from matloom.operators import density


def _plain(x, min_points):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d + np.where(np.eye(n, dtype=bool), np.inf, 0), 1)[:, min_points - 2]
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    root, out = list(range(n)), []

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in sorted((float(w[i, j]), i, j) for i in range(n) for j in range(i + 1, n)):
        a, b = top(e[1]), top(e[2])
        if a != b:
            root[a] = b
            out.append(e)
    return out


def test_tree_with_ties_and_copies_holds_few_rows_against_all(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(0, 4, (150, 3)).astype(float), np.tile([[9.0, 9, 9]], (40, 1)), rng.normal(size=(150, 3)) + 20])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    asked, searched = [], density._searched

    def counted(asking, rows):
        asked.append(asking.count())
        return searched(asking, rows)

    monkeypatch.setattr(density, "_searched", counted)
    assert sorted(map(tuple, density.spanning_tree(v, 4).collect())) == _plain(x, 4)
    assert sum(asked) < 4 * len(x)
