"""Hierarchical density clusters against the definition, top down, over all pairs."""

import numpy as np
import pytest

from matloom.operators import density


def plain(x, min_points, least):
    """label sets, levels and worth from the full matrix, splitting from the top."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d + np.where(np.eye(n, dtype=bool), np.inf, 0), 1)[:, min_points - 2] if min_points > 1 else np.zeros(n)
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    reached, edges = [0], []
    while len(reached) < n:
        rest = [j for j in range(n) if j not in reached]
        e = min((w[i, j], min(i, j), max(i, j)) for i in reached for j in rest)
        edges.append(e)
        reached.append(e[2] if e[1] in reached and e[2] not in reached else e[1])
    edges.sort()

    def split(points, inner):
        """The last edge of a component, and its two sides."""
        *inner, last = inner
        side, grown = {last[1]}, True
        while grown:
            grown = False
            for _, a, b in inner:
                if (a in side) != (b in side):
                    side |= {a, b}
                    grown = True
        other = points - side
        return last, [(s, [e for e in inner if e[1] in s]) for s in (side, other)]

    level, cluster_of, out = {}, {}, []

    def cluster(points, inner, birth):
        """id, the worth of the best choice, and the largest level."""
        me = len(out)
        out.append(None)
        worth, top, kids, choice, size = 0.0, 0.0, [], None, len(points)
        while True:
            last, sides = split(points, inner)
            now = 1 / max(last[0], 1e-10)
            big = [s for s in sides if len(s[0]) >= least]
            for s, _ in sides:
                if len(s) < least:
                    for p in s:
                        level[p], cluster_of[p] = now, me
                    worth += (now - birth) * len(s)
                    top = max(top, now)
            if len(big) == 2:
                worth += sum((now - birth) * len(s) for s, _ in big)
                kids = [cluster(*s, now) for s in big]
                break
            if not big:
                break
            points, inner = big[0]
        best = sum(k[1] for k in kids)
        own = worth >= best
        out[me] = (own, [k[0] for k in kids], max([top, *[k[2] for k in kids]]))
        return me, max(worth, best), out[me][2]

    if n >= least:
        cluster(set(range(n)), edges, 0.0)
    chosen = {}

    def choose(me, over):
        own, kids, _ = out[me]
        pick = over if over is not None else me if own and me else None
        chosen[me] = pick
        for k in kids:
            choose(k, pick)

    if out:
        choose(0, None)
    rows = {}
    for p in range(n):
        c = cluster_of.get(p)
        pick = chosen.get(c)
        rows[p] = (pick, level[p] / out[pick][2] if pick is not None else 0.0, 1 - level[p] / out[c][2] if c is not None else 0.0)
    return rows, sum(e[0] for e in edges)


def points(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>").repartition(3)


@pytest.mark.parametrize(("seed", "min_points", "least", "step"), [(0, 4, 5, 1_000_000), (1, 3, 4, 17), (2, 5, 8, 31)])
def test_clusters_equal_the_definition(spark, monkeypatch, seed, min_points, least, step):
    monkeypatch.setattr(density, "EDGES", step)
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (k, 2)) for c, s, k in (((0, 0), 0.3, 25), ((4, 0), 0.5, 20), ((4, 3), 0.2, 15))] + [rng.uniform(-3, 8, (12, 2))])
    want, weight = plain(x, min_points, least)
    tree = density.spanning_tree(points(spark, x), min_points).collect()
    assert len(tree) == len(x) - 1 and abs(sum(r.w for r in tree) - weight) < 1e-9
    got = {r.id: r for r in density.hdbscan(points(spark, x), min_points, least).collect()}
    names = {}
    for p in sorted(want):
        pick, probability, outlier = want[p]
        label = 0 if pick is None else names.setdefault(pick, len(names) + 1)
        assert got[p].label == label and abs(got[p].probability - probability) < 1e-9 and abs(got[p].outlier - outlier) < 1e-9
    assert len(names) >= 2


def test_clusters_of_equal_points_few_and_none(spark):
    x = np.array([[0.0, 0]] * 6 + [[5.0, 5]] * 6 + [[100.0, 0]])
    got = sorted(map(tuple, density.hdbscan(points(spark, x), 3, 4).select("id", "label").collect()))
    assert got == [(i, 1) for i in range(6)] + [(i, 2) for i in range(6, 12)] + [(12, 0)]
    assert [tuple(r) for r in density.hdbscan(points(spark, x[:1]), 3, 4).collect()] == [(0, 0, 0.0, 0.0)]
    assert {r.label for r in density.hdbscan(points(spark, x[:3] + np.arange(3)[:, None]), 2, 5).collect()} == {0}
    assert density.hdbscan(points(spark, x).limit(0), 3, 4).count() == 0
