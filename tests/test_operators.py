"""Hand-made fixtures and invariants of the matrix and graph operators."""

import itertools
import math

import numpy as np
import pytest

from matloom.operators import archetypes, coo, graph, knn, layout, linalg, matching, simplex, stats
from matloom.plans.components import components
from matloom.plans.prefix import running

TINY_G = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (2, 3, 0.5), (3, 4, 0.5)]


def both_ways(edges):
    return edges + [(b, a, w) for a, b, w in edges]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame(both_ways(TINY_G), "src long, dst long, weight double"), spark.range(6).select("id")


def rows(df, *keys):
    return sorted(tuple(r) for r in (df.select(*keys) if keys else df).collect())


def matrix(spark, entries):
    return spark.createDataFrame(entries, "row_id long, col_id long, value double")


def test_normalize_keeps_sign_and_zero_columns(spark):
    m = matrix(spark, [(0, 0, 3.0), (1, 0, -1.0), (0, 2, 2.0)])
    assert rows(coo.normalize(m)) == [(0, 0, 0.75), (0, 2, 1.0), (1, 0, -0.25)]
    assert rows(coo.normalize(m, p=0)) == rows(m)
    with pytest.raises(ValueError):
        coo.normalize(m, p=3)


def test_empty_matrix(spark):
    m = matrix(spark, [])
    assert rows(coo.normalize(m)) == []
    assert rows(coo.times_vector(m, spark.createDataFrame([(0, 1.0)], "id long, value double"))) == []


def test_graph_norms_and_empty_nodes(spark, tiny):
    g, nodes = tiny
    for method, key in ((0, "dst"), (1, "src")):
        sums = rows(coo.normalize_graph(g, nodes, method).groupBy(key).sum("weight"))
        assert [k for k, _ in sums] == list(range(6)) and all(abs(s - 1) < 1e-12 for _, s in sums)
    assert 5 not in [r[0] for r in rows(coo.normalize_graph(g, nodes, 2))]
    with pytest.raises(ValueError):
        coo.normalize_graph(g, nodes, 3)


def test_zscores(spark):
    x = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (0, 1, 1.0), (1, 1, 3.0)], "id long, dim int, value double")
    z = {(r.id, r.dim): r.value for r in coo.zscore(x).collect()}
    assert z[0, 0] == z[1, 0] == 0 and abs(z[1, 1] - math.sqrt(0.5)) < 1e-12
    with pytest.raises(NotImplementedError):
        coo.normalize_scores(x, 2)
    y = spark.createDataFrame([(i, 0, v) for i, v in enumerate([1.0, 1.0, 1.0, 5.0])], "id long, dim int, value double")
    assert sorted(r.value for r in coo.robust_zscore(y).collect()) == [0, 0, 0, math.inf]


def test_ranks_with_ties(spark):
    x = spark.createDataFrame([(0, 10.0), (1, 20.0), (2, 20.0), (3, 30.0)], "id long, value double")
    assert rows(coo.rank(x)) == [(0, 1.0), (1, 2.5), (2, 2.5), (3, 4.0)]
    assert rows(coo.rank(x, "max")) == [(0, 1.0), (1, 3.0), (2, 3.0), (3, 4.0)]
    assert rows(coo.rank(x, "max", True)) == [(0, 1.0), (1, 2.0), (2, 2.0), (3, 4.0)]


def test_running_matches_numpy(spark):
    v = np.random.default_rng(0).integers(0, 9, 500)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "i int, x int")
    assert [r.s for r in sorted(running(df, ["i"], {"x": "s"}).collect(), key=lambda r: r.i)] == (np.cumsum(v) - v).tolist()


def test_grouped_counts_implicit_zeros(spark):
    m = matrix(spark, [(0, 0, 2.0), (0, 1, 4.0), (1, 2, 3.0)])
    groups = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 2)], "id long, grp long")
    ids = spark.range(2).select("id")
    assert rows(coo.grouped(m, groups, ids, "sum")) == [(0, 1, 6.0), (0, 2, 0.0), (1, 1, 3.0), (1, 2, 0.0)]
    got = {(r.row_id, r.grp): r.value for r in coo.grouped(m, groups, ids, "var").collect()}
    assert abs(got[0, 1] - np.var([2, 4, 0], ddof=1)) < 1e-12 and got[0, 2] == 0


@pytest.mark.parametrize("metric", knn.METRICS)
def test_neighbours_against_brute_force(spark, metric):
    rng = np.random.default_rng(1)
    x = rng.dirichlet(np.ones(5), 60)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    got = {}
    for r in knn.neighbours(v, 4, metric).collect():
        got.setdefault(r.id, []).append((r.pos, r.nbr))
    d = knn.exact(x[:, None, :], x[None, :, :], metric)
    np.fill_diagonal(d, np.inf)
    for i in range(60):
        assert [n for _, n in sorted(got[i])] == np.lexsort((np.arange(60), d[i]))[:4].tolist()


@pytest.mark.parametrize("metric", knn.METRICS)
def test_neighbours_among_many_equal_ones(metric):
    """Tiles choose by inexact distances; equal rows and ties go by the smaller name all the same."""
    rng = np.random.default_rng(2)
    x = rng.dirichlet(np.ones(6), 300)
    x[50:180] = x[7]
    names = rng.permutation(300)
    d = knn.exact(x[:, None, :], x[None, :, :], metric)
    d[names[:, None] == names[None, :]] = np.inf
    real, who = knn.nearest(x, names, x, names, 12, metric, True)
    for i in range(300):
        order = np.lexsort((names, d[i]))[:12]
        assert who[i].tolist() == names[order].tolist() and np.allclose(real[i], d[i][order], atol=1e-12)


@pytest.mark.parametrize("metric", knn.METRICS)
def test_cells_find_nine_tenths_of_the_neighbours(spark, metric):
    rng = np.random.default_rng(3)
    x = np.abs(rng.standard_normal((30, 16)))[rng.integers(0, 30, 1500)] + 0.25 * np.abs(rng.standard_normal((1500, 16)))
    x[:500] = x[3] + 0.01 * np.abs(rng.standard_normal((500, 16)))  # a hot cell
    x = x / x.sum(1, keepdims=True) if metric == "jsd" else x / np.linalg.norm(x, axis=1, keepdims=True)
    v = vectors_of(spark, x)
    want = {(r.id, r.nbr) for r in knn.neighbours(v, 10, metric).collect()}
    got = knn.approximate(v, 10, metric).collect()
    assert len(want & {(r.id, r.nbr) for r in got}) >= 0.9 * len(want) and max(r.pos for r in got) == 10
    assert knn.approximate(v.limit(0), 3, metric).count() == 0


def test_neighbours_of_one_row(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0])], "id long, vec array<double>")
    assert knn.neighbours(v, 3, "l2").count() == 0


def test_unknown_names_raise(spark):
    v = spark.createDataFrame([(0, [1.0])], "id long, vec array<double>")
    with pytest.raises(ValueError):
        knn.build(v, "other")
    with pytest.raises(ValueError):
        knn.neighbours(v, 1, "cosine")


def test_diffusion_keeps_mass(spark):
    g = spark.createDataFrame(both_ways(TINY_G), "src long, dst long, weight double")
    nodes = spark.range(5).select("id")
    x0 = spark.createDataFrame([(0, 0, 1.0), (3, 1, 2.0)], "id long, dim int, value double")
    for d, s in rows(graph.diffuse(g, nodes, x0).groupBy("dim").sum("value")):
        assert abs(s - 1) < 1e-9
    assert rows(graph.diffuse(g, nodes, x0, alpha=0)) == rows(x0)
    with pytest.raises(ValueError):
        graph.diffuse(g, nodes, x0, alpha=2)


def test_coreness(spark, tiny):
    assert rows(graph.coreness(*tiny)) == [(0, 2), (1, 2), (2, 2), (3, 1), (4, 1), (5, 0)]


def test_propagation_keeps_fixed_labels(spark, tiny):
    g, nodes = tiny
    start = spark.createDataFrame([(0, 1), (4, 2)], "id long, label int")
    got = dict(rows(graph.propagate(g, nodes, start, start.select("id"), least=0.0)))
    assert got[0] == 1 and got[4] == 2


def test_propagation_sets_the_weight_of_self_loops(spark, tiny):
    """Those of the graph do not count, at whichever weight."""
    g, nodes = tiny
    start = spark.createDataFrame([(0, 1), (4, 2)], "id long, label int")
    loops = g.union(nodes.selectExpr("id AS src", "id AS dst", "99.0D AS weight"))
    for own in (0.0, 2.0):
        assert rows(graph.propagate(loops, nodes, start, self_weight=own, least=0.0)) == rows(graph.propagate(g, nodes, start, self_weight=own, least=0.0))


def test_seeds_of_zeros_stay_zeros(spark, tiny):
    g, nodes = tiny
    x0 = spark.createDataFrame([(0, 0, 1.0), (1, 1, 0.0)], "id long, dim int, value double")
    got = dict(rows(graph.diffuse(g, nodes, x0).groupBy("dim").sum("value")))
    assert abs(got[0] - 1) < 0.2 and got[1] == 0
    with pytest.raises(ValueError):
        graph.diffuse_chebyshev(g, nodes, x0, alpha=-1)


def test_cores_by_rounds_and_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(9)
    e = {(int(a), int(b)) for a, b in rng.integers(0, 60, (260, 2))}
    g = spark.createDataFrame([(a, b, 1.0) for a, b in e | {(b, a) for a, b in e}], "src long, dst long, weight double")
    nodes = spark.range(62).select("id")
    few = rows(graph.coreness(g, nodes))
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    assert rows(graph.coreness(g, nodes)) == few and len(few) == 62 and few[61] == (61, 0)


def test_rounds_leave_no_tables_behind(spark, tiny, monkeypatch):
    from matloom.plans import materialize

    monkeypatch.setattr(graph, "ONE_TASK", 0)
    before = len(materialize._WRITTEN)
    graph.coreness(*tiny).collect()
    assert len(materialize._WRITTEN) == before + 2


def test_few_nodes_have_no_moments(spark):
    g = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, weight double")
    x = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "id long, dim int, value double")
    got = stats.moran_parametric(g, x, 2).first()
    assert got.z is None and got.stat is not None
    s = matrix(spark, [(0, 0, 1.0), (0, 1, 2.0)])
    assert stats.signature(s, matrix(spark, [(0, 0, 1.0)]), spark.range(2).select("id"), 1).count() == 2


def test_specificity_raises_negative_entries(spark):
    s, h = matrix(spark, [(0, 0, -1.0), (0, 1, 3.0), (1, 1, 2.0)]), spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.5)], "id long, dim int, value double")
    assert rows(stats.specificity(s, h, 2, 2)) == rows(stats.specificity(matrix(spark, [(0, 0, 0.0), (0, 1, 4.0), (1, 1, 3.0)]), h, 2, 2))


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)], "u long, v long")
    assert rows(components(e)) == [(1, 1), (2, 1), (3, 1), (7, 1), (8, 1), (9, 1), (20, 20), (21, 20)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long").repartition(7)
    assert {r.component for r in components(chain).collect()} == {0}


def test_constant_signal_has_no_statistic(spark, tiny):
    g, nodes = tiny
    x = nodes.selectExpr("id", "0 AS dim", "3.0D AS value")
    assert stats.moran(g, x, 6).collect()[0].stat is None


def test_xicor_of_a_function_tends_to_one(spark):
    n = 400
    pairs = spark.createDataFrame([(0, 1, i, float(i), float((i - 200) ** 2)) for i in range(n)], "i int, j int, id long, x double, y double")
    assert stats.xicor(pairs, n).first().xi > 0.9


def test_enrichment_of_tiny_sets_is_zero(spark):
    s = spark.createDataFrame([(i, float(10 - i)) for i in range(10)], "id long, score double")
    x = matrix(spark, [(0, 1, 1.0)] + [(i, 2, 1.0) for i in range(4)])
    got = {r.set: (r.logp, r.threshold) for r in stats.set_enrichment(s, x).collect()}
    assert got[1] == (0.0, 0) and got[2][0] > 0 and got[2][1] == 3


def vectors_of(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")


@pytest.mark.parametrize("algorithm", ["irlb", "halko", "feng"])
def test_svd_against_numpy(spark, algorithm):
    x = np.random.default_rng(0).standard_normal((80, 12)) * np.linspace(5, 0.1, 12)
    v = vectors_of(spark, x)
    got = linalg.svd(v, 3, algorithm, rounds=30)
    assert np.allclose(got.values, np.linalg.svd(x, compute_uv=False)[:3], rtol=1e-4)
    right = np.array([r.vec for r in got.right(v).orderBy("id").collect()])
    assert np.allclose(right.T @ right, np.eye(3), atol=1e-4)


def test_krylov_steps_against_numpy(spark):
    """The branch for many features, at few."""
    x = np.random.default_rng(1).standard_normal((90, 24)) * np.linspace(4, 0.1, 24)
    got = linalg.svd(vectors_of(spark, x), 3, whole=0)
    u, s, _ = np.linalg.svd(x.T, full_matrices=False)
    assert np.allclose(got.values, s[:3], rtol=1e-6) and np.allclose(np.abs((u[:, :3] * got.left).sum(0)), 1, atol=1e-5)
    q, s, w = linalg.eig_svd(x)
    assert np.allclose(q * s @ w.T, x)
    with pytest.raises(ValueError):
        linalg.svd(vectors_of(spark, x), 3, "other")


def test_batches_are_taken_out(spark):
    """Three profiles, against projections."""
    x = np.random.default_rng(7).standard_normal((50, 8))
    v = vectors_of(spark, x)
    d = np.eye(3)[np.arange(50) % 3]
    got = linalg.orthogonalize_batch(v, linalg.svd(v, 8), vectors_of(spark, d))
    z = linalg.gram_schmidt(x.T @ d)
    r = x.T - z @ (z.T @ x.T)
    assert np.allclose(got.values, np.linalg.svd(r - r.mean(0), compute_uv=False)[:8], atol=1e-6)


def test_perturbed_svd_is_the_svd_of_the_sum(spark):
    x = np.random.default_rng(2).standard_normal((40, 6))
    v = vectors_of(spark, x)
    a = np.random.default_rng(3).standard_normal((6, 2))
    p, c = np.random.default_rng(4).standard_normal((6, 2)), np.array([0.5, -1.0])
    got = linalg.perturbed(v, linalg.svd(v, 6), a, p, c)
    want = x.T + a @ (x @ p + c).T
    u, s, _ = np.linalg.svd(want, full_matrices=False)
    assert np.allclose(got.values, s[:6])
    right = np.array([r.vec for r in got.right(v).orderBy("id").collect()])
    assert np.allclose(got.left * got.values @ right.T, want)


def test_gram_schmidt_drops_dependent_columns():
    q = linalg.gram_schmidt(np.array([[1.0, 2.0, 0.0], [0.0, 0.0, 1.0]]))
    assert np.allclose(q[:, 1:], 0)


def test_simplex_regression_is_optimal():
    rng = np.random.default_rng(0)
    for p in (1, 2, 4):
        a = rng.standard_normal((3, p))
        for _ in range(20):
            b = rng.standard_normal(3)
            x = simplex.solve(a, b)
            grid = [np.array(t) / 20 for t in itertools.product(range(21), repeat=p) if sum(t) == 20]
            assert abs(x.sum() - 1) < 1e-9 and x.min() >= 0
            assert np.linalg.norm(a @ x - b) <= min(np.linalg.norm(a @ g - b) for g in grid) + 1e-9


def test_archetypes_of_a_separable_matrix(spark):
    rng = np.random.default_rng(5)
    corners = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1]])
    x = np.concatenate([corners, rng.dirichlet(np.ones(3) * 2, 20) @ corners])
    v = vectors_of(spark, x)
    assert sorted(i for i, _ in simplex.spa(v, 3)) == [0, 1, 2]
    with pytest.raises(ValueError):
        archetypes.pipeline(v, 3, 3, rounds=20, least_obs=99)
    got = archetypes.pipeline(v, 2, 4, rounds=20, least_obs=1)
    h = np.array([r.vec for r in got.weights.collect()])
    assert np.allclose(h.sum(1), 1) and h.min() >= 0 and got.labels.count() == 23


def test_matching_against_all_permutations(spark):
    rng = np.random.default_rng(6)
    for n, m in ((4, 4), (3, 5), (5, 2)):
        w = np.round(rng.uniform(-2, 5, (n, m)), 3)
        got = matching.hungarian(matrix(spark, [(i, j, float(w[i, j])) for i in range(n) for j in range(m)])).collect()
        small = np.maximum(w if n <= m else w.T, 0)
        best = max(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
        assert abs(sum(r.value for r in got) - best) < 1e-9 and len({r.row_id for r in got}) == len(got) == len({r.col_id for r in got})
    assert matching.hungarian(matrix(spark, [(0, 0, -1.0)])).count() == 0


def test_find_ab_fits_the_plateau():
    a, b = layout.find_ab(1.0, 0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.02


def test_layout_is_finite_and_repeats(spark, tiny):
    g, nodes = tiny
    start = nodes.selectExpr("id", "array(cos(id), sin(id)) AS vec")
    one, two = [rows(layout.layout(g, start, "umap", epochs=50)) for _ in range(2)]
    assert one == two and np.isfinite([v for _, v in one]).all()
    for at_once in (0, 3):
        got = rows(layout.layout(g, start, "tumap", epochs=30, optimizer="sgd", at_once=at_once))
        assert np.isfinite([v for _, v in got]).all() and got != one
    assert rows(layout.layout(g, start, "umap", epochs=50, beta1=0.9)) != one
    with pytest.raises(ValueError):
        layout.optimize(np.zeros((2, 2)), np.zeros(0, int), np.zeros(0, int), np.zeros(0), 1, at_once=5)


def test_components_beyond_one_task(spark, monkeypatch):
    import random

    from matloom.plans import components as module

    rng = random.Random(0)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(350)]
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(5)
    few = rows(components(edges))
    monkeypatch.setattr(module, "FLUSH", 3)
    assert rows(components(edges)) == few
    forest = module.Forest()
    for a, b in pairs:
        forest.join(a, b)
    assert few == sorted((x, forest.root(x)) for x in {n for a, b in pairs if a != b for n in (a, b)})


def test_written_tables_have_few_files(spark, tmp_path):
    """However many partitions a session has: the local file system starts processes for each file."""
    import os

    from matloom.plans import materialize

    got = materialize.cut(spark.range(5000).repartition(300), "few")
    names = [n for n in os.listdir(got._written.removeprefix("file://")) if not n.startswith(".")]
    assert len(names) <= materialize.FILES * spark.sparkContext.defaultParallelism
    assert "_SUCCESS" not in names and got.count() == 5000 and got.agg({"id": "sum"}).first()[0] == 4999 * 2500


def test_broadcasts_are_small(spark):
    """A driver of 750 MB of heap holds several at once."""
    from matloom.plans.joins import broadcast_if_small

    some = lambda n: broadcast_if_small(spark.range(n))._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" in some(1000) or "UnresolvedHint" in some(1000)
    assert "Hint" not in some(300_000)


def test_rows_by_the_ten_thousand_are_not_broadcast(spark):
    """Twenty joins of one plan with up to 70,000 rows each took a driver beyond its memory."""
    from matloom.plans.joins import broadcast_if_small

    assert "Hint" not in broadcast_if_small(spark.range(30_000))._jdf.queryExecution().logical().toString()
