"""Regression, archetypes and factors that no task holds whole, against the same at hand."""

import duckdb
import numpy as np
import pytest

from matloom.operators import archetypes, convex, factors, linalg, simplex, sparse
from matloom.operators import dense as dense_module
from matloom.operators.linalg import reduce_kernel

SF = "/root/testdata/sf0.01"


def table(spark, x, **more):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>").repartition(5)


def test_frank_wolfe_equals_the_regression_at_hand(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 6))
    targets = np.concatenate([0.3 * rng.standard_normal((6, 3)), 5 * rng.standard_normal((6, 1)), x[7][:, None]], 1)
    got = convex.frank_wolfe(table(spark, x), targets, tol=1e-10)
    for t, a in enumerate(got):
        want = simplex.solve(x.T, targets[:, t])
        assert a.gap <= 1e-10 * max((targets[:, t] ** 2).sum(), (a.x**2).sum(0).max())
        assert abs(a.weights.sum() - 1) < 1e-12 and (a.weights >= 0).all()
        assert np.linalg.norm(a.point() - x.T @ want) < 1e-4
        assert np.allclose(a.x, x[a.ids].T)
    # Started from what it has found, one pass is enough.
    again = convex.frank_wolfe(table(spark, x), targets, tol=1e-10, start=got)
    assert all(b.passes - 1 <= a.passes for a, b in zip(got, again))


def test_frank_wolfe_of_ties_one_row_and_none(spark):
    x = np.array([[1.0, 0.0]] * 5)
    got = convex.frank_wolfe(table(spark, x), np.array([[2.0], [1.0]]))[0]
    assert got.ids == [0] and got.weights.tolist() == [1.0]
    with pytest.raises(ValueError):
        convex.frank_wolfe(table(spark, x).limit(0), np.ones((2, 1)))


@pytest.fixture(scope="module")
def mixtures():
    rng = np.random.default_rng(4)
    corners = np.array([[0.0, 0, 1], [4, 0, 1], [0, 4, 1]])
    h = rng.dirichlet(np.ones(3), 200)
    h[:3] = np.eye(3)
    return corners, h @ corners


def test_archetypes_by_passes_equal_those_at_hand(spark, mixtures):
    corners, x = mixtures
    v = table(spark, x)
    start = x[[10, 20, 30]].T
    want = simplex.aa(x.T, start, rounds=8, tol=0)
    got = convex.archetypes(v, start, rounds=8, tol=0)
    w = x.T @ want.c
    assert np.abs(got.w - w).max() < 1e-3
    rest = ((x.T - w @ want.h) ** 2).sum()
    assert got.residual <= rest * 1.01 + 1e-6
    c = got.combinations(spark).collect()
    back = np.zeros_like(w)
    for r in c:
        back[:, r.arch] += r.c * x[r.id]
    assert np.allclose(back, got.w)


def test_analysis_gives_what_archetypes_are_made_of(spark, mixtures):
    _, x = mixtures
    v, start = table(spark, x), x[[10, 20, 30]].T
    for passes in (False, True):
        got = archetypes.analysis(v, start, rounds=3, passes=passes)
        made = np.zeros_like(got.w)
        for r in got.c.collect():
            made[:, r.arch] += r.c * x[r.id]
        assert np.allclose(made, got.w)
        h = dense(got.h, len(x), 3)
        assert (h >= 0).all() and np.allclose(h.sum(1), 1)


def test_what_orthogonalising_adds(spark):
    """S plus A Bᵀ is the decomposed matrix."""
    rng = np.random.default_rng(6)
    x = rng.random((20, 5))
    v = table(spark, x)
    got = linalg.orthogonalize_basal(v, linalg.svd(v, 5), rng.random((5, 2)))
    b, right = dense(got.added(v), 20, 3), dense(got.right(v), 20, 5)
    assert got.a.shape == (5, 3)
    assert np.allclose(x.T + got.a @ b.T, (got.left * got.values) @ right.T, atol=1e-8)
    assert linalg.svd(v, 2).added(v) is None


def test_products_go_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(dense_module, "TILE", 3)
    rng = np.random.default_rng(9)
    x = rng.random((30, 8))
    v = table(spark, x)
    got = dense_module.gram(v)
    assert got.n == 30 and np.allclose(got.total, x.sum(0)) and np.allclose(got.products, x.T @ x)
    r = np.corrcoef(x.T)
    rows = dense_module.correlations(v).collect()
    assert len(rows) == 64 and all(abs(r[e.i, e.j] - e.r) < 1e-12 for e in rows)
    assert dense_module.correlations(v.limit(0)).count() == 0
    monkeypatch.setattr(dense_module, "MOST", 7)
    with pytest.raises(ValueError):
        dense_module.gram(v)


def test_traces_beyond_what_a_task_holds(spark, mixtures, monkeypatch):
    _, x = mixtures
    monkeypatch.setattr(archetypes, "LIMIT", 100)
    v = table(spark, x)
    with pytest.raises(ValueError):
        archetypes.trace(v, 2, 3)
    t = archetypes.trace(v, 2, 3, rounds=3, passes=True).collect()
    assert {(r.k, r.arch) for r in t} == {(2, 0), (2, 1), (3, 0), (3, 1), (3, 2)}
    for k in (2, 3):
        for i in range(5):
            assert abs(sum(r.h for r in t if r.k == k and r.id == i) - 1) < 1e-9
        for a in range(k):
            assert abs(sum(r.c for r in t if r.k == k and r.arch == a) - 1) < 1e-9


def test_coreset_stands_for_the_whole(spark, mixtures):
    corners, x = mixtures
    rng = np.random.default_rng(2)
    y = x[rng.integers(0, 200, 4000)] + 0.05 * rng.standard_normal((4000, 3))
    v = table(spark, y).cache()
    sample = convex.coreset(v, 400).cache()
    assert sample.count() == 400 and sample.select("id").distinct().count() == 400
    assert abs(sample.agg({"weight": "sum"}).first()[0] / 4000 - 1) < 0.15
    start = y[[1, 2, 3]].T
    whole = convex.archetypes(v, start, rounds=6)
    small = convex.archetypes(sample, start, rounds=6)

    def residual(w):
        return sum(((b - w @ simplex.solve(w, b)) ** 2).sum() for b in y)

    assert abs(small.residual / residual(small.w) - 1) < 0.3
    assert residual(small.w) < 1.3 * whole.residual + 1e-6
    assert convex.coreset(v.limit(3), 10).count() == 3


def test_online_archetypes_of_a_stream_that_stops(spark, tmp_path, mixtures):
    _, x = mixtures
    x = x[np.linalg.norm(x, axis=1) > 0]
    start = x[[10, 20, 30]].T
    source = tmp_path / "rows"
    for i in range(2):
        table(spark, x[i * 60 : (i + 1) * 60]).coalesce(1).write.parquet(f"{source}/{i}", mode="overwrite")

    def run(at, folder):
        stream = spark.readStream.schema("id long, vec array<double>").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
        q = convex.online(stream, start, str(at))
        q.awaitTermination()
        assert q.exception() is None

    run(tmp_path / "a", str(source))
    table(spark, x[120:180]).coalesce(1).write.parquet(f"{source}/2")
    run(tmp_path / "a", str(source))  # goes on with the new file
    got = convex.Online.load(spark, f"{tmp_path}/a/model/2")
    run(tmp_path / "a", str(source))  # nothing new
    want = convex.Online.start(start)
    for i in range(3):
        want = want.seen(table(spark, x[i * 60 : (i + 1) * 60]))
    assert np.allclose(got.a, want.a) and np.allclose(got.b, want.b)
    # A batch that is run again, from the model before it, gives the same model.
    again = convex.Online.load(spark, f"{tmp_path}/a/model/1").seen(table(spark, x[120:180]))
    assert np.allclose(again.w, got.w)
    unit = x[:180] / np.linalg.norm(x[:180], axis=1, keepdims=True)
    rest = lambda w: sum(((b - w @ simplex.solve(w, b)) ** 2).sum() for b in unit)
    assert rest(got.w) < rest(convex.Online.start(start).w)
    assert rest(got.w) < 4 * convex.archetypes(table(spark, unit), convex.Online.start(start).w, rounds=10).residual + 0.5


def entries(spark, x):
    return spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "row_id long, col_id long, value double").repartition(4)


def dense(df, rows, k):
    out = np.zeros((rows, k))
    for r in df.collect():
        out[r.id] = r.vec
    return out


def test_sparse_svd_restarts(spark):
    """Quantities of parts and suppliers, with values that fall off, so that a few vectors do not reach them at once."""
    got = duckdb.sql(f"SELECT l_partkey, l_suppkey, sum(l_quantity) FROM '{SF}/lineitem.parquet' WHERE l_partkey <= 300 GROUP BY ALL").fetchall()
    x = np.zeros((301, 101))
    for i, j, q in got:
        x[i, j] = q * 0.85 ** (j % 20)
    found = sparse.svd(entries(spark, x), 2)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(found.values, s[:2], rtol=1e-8) and (found.residuals <= 1e-6 * s[0]).all() and found.restarts > 1
    left, right = dense(found.left, x.shape[0], 2), dense(found.right, x.shape[1], 2)
    assert np.allclose(x @ right, left * found.values, atol=1e-5 * s[0]) and np.allclose(x.T @ left, right * found.values, atol=1e-5 * s[0])
    assert np.allclose(left.T @ left, np.eye(2), atol=1e-8)
    assert ((left * np.abs(left)).sum(0) >= 0).all()


@pytest.mark.parametrize("shape", [(4, 40), (40, 4), (6, 6), (1, 3)])
def test_sparse_svd_of_small_and_degenerate_matrices(spark, shape):
    rng = np.random.default_rng(sum(shape))
    x = rng.standard_normal(shape) * (rng.random(shape) < 0.7)
    x[0, 0] = 1
    if shape[0] == 40:
        x[:, 1] = x[:, 0]  # of lower rank
    if shape == (6, 6):
        x = np.eye(6)  # equal values
    s = np.linalg.svd(x, compute_uv=False)
    found = sparse.svd(entries(spark, x), 3)
    assert np.allclose(found.values, s[: len(found.values)], atol=1e-8)
    with pytest.raises(ValueError):
        sparse.svd(entries(spark, x).limit(0), 2)


def test_sparse_reduced_kernel_equals_the_dense_one(spark):
    rng = np.random.default_rng(7)
    x = rng.random((12, 30)) * (rng.random((12, 30)) < 0.5)  # features x observations
    x[3] = 0
    x[:, 4] = 0
    want = reduce_kernel(table(spark, x.T), 4, grid=0)
    got = sparse.reduce_kernel(entries(spark, x), spark.range(12), spark.range(30), 4, grid=0, tol=1e-9)
    assert np.allclose(got.values, want.svd.values, atol=1e-8)
    assert np.allclose(np.abs(dense(got.left, 12, 4)), np.abs(want.svd.left), atol=1e-6)
    assert np.allclose(np.abs(dense(got.reduced, 30, 4)), np.abs(dense(want.reduced, 30, 4)), atol=1e-6)
    rounded = dense(sparse.reduce_kernel(entries(spark, x), spark.range(12), spark.range(30), 4).reduced, 30, 4) / got.values
    step = 0.01 / np.sqrt(30)
    assert np.allclose(rounded / step, np.round(rounded / step), atol=1e-6)


def test_factors_of_signs(spark):
    rng = np.random.default_rng(3)
    x = rng.random((50, 7))
    got = factors.nndsvd(table(spark, x), 3)
    left, right = got.features, dense(got.observations, 50, 3)
    u, s, vt = np.linalg.svd(x.T, full_matrices=False)
    assert (left >= 0).all() and (right >= 0).all() and np.allclose(got.weights, s[:3])
    for i in range(3):
        parts = [(np.maximum(g * u[:, i], 0), np.maximum(g * vt[i], 0)) for g in (1, -1)]
        a, b = max(parts, key=lambda p: np.linalg.norm(p[0]) * np.linalg.norm(p[1]))
        assert np.allclose(np.outer(left[:, i], right[:, i]), s[i] * np.outer(a, b), atol=1e-8)


def plain_under(m, k, rounds):
    xs, ys, weights, rest, whole = [], [], [], [], (m * m).sum()
    for _ in range(k):
        u, s, vt = np.linalg.svd(m, full_matrices=False)
        y, x = np.abs(u[:, 0]) * np.sqrt(s[0]), np.abs(vt[0]) * np.sqrt(s[0])
        over = np.maximum(np.outer(y, x) - m, 0)
        for j in range(rounds):
            new = np.maximum((m - over).T @ y, 0)
            new /= new.max() + 1e-16
            other = np.maximum((m - over) @ new, 0) / (new @ new)
            if new.sum() and other.sum():
                x, y = new, other
                over = np.maximum(over - (m - np.outer(y, x)) / (j + 1), 0)
            else:
                over /= 2
        m = np.maximum(m - np.outer(y, x), 0)
        rest.append((m * m).sum() / whole)
        xs.append(x / x.sum())
        ys.append(y / y.sum())
        weights.append(x.sum() * y.sum())
    return np.stack(xs, 1), np.stack(ys, 1), np.array(weights), np.array(rest)


def test_underapproximations(spark):
    rng = np.random.default_rng(8)
    x = rng.random((40, 2)) @ rng.random((2, 6)) + 0.05 * rng.random((40, 6))
    got = factors.underapproximations(table(spark, x), 2, rounds=6)
    a, b, weights, rest = plain_under(x.copy(), 2, 6)
    assert np.allclose(got.features, a, atol=1e-8) and np.allclose(dense(got.observations, 40, 2), b, atol=1e-8)
    assert np.allclose(got.weights, weights) and np.allclose(got.rest, rest) and got.rest[1] < got.rest[0] < 1
    strict = factors.underapproximations(table(spark, x), 2, rounds=6, strict=True)
    below = (dense(strict.observations, 40, 2) * strict.weights) @ strict.features.T
    assert (below <= x + 1e-12).all() and strict.rest[1] < strict.rest[0] < 1
