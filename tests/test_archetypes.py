"""What archetypes survive by, worked out in plain loops; layouts' schedule on a hand-made graph."""

import math

import numpy as np

from matloom.operators import archetypes, layout

TRACE = "k int, arch int, id long, h double, c double"


def looped(h: np.ndarray, c: np.ndarray):
    """Transitivity, landmark and number of observations of every archetype (row of h, column of c), by the definitions."""
    n = len(h)
    b = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            if i != j and h[i].std() > 0 and h[j].std() > 0:
                b[i, j] = max(0.0, np.corrcoef(h[i], h[j])[0, 1])
    tr, marks = [], []
    for k in range(n):
        total = sum((b[k, i] + b[k, j]) / 2 for i in range(n) for j in range(n) if b[i, k] * b[k, j] * b[j, i] > 0)
        s, d = b[k].sum(), (b[k] > 0).sum()
        tr.append(total / (s * (d - 1)) if s * (d - 1) else None)
        own = [(c[i, k], -i) for i in range(h.shape[1]) if h[k].max() - h[k, i] < 1e-3 and c[i, k] > 0]
        marks.append(-max(own)[1] if own else None)
    return tr, marks, [(c[:, k] > 1e-6).sum() for k in range(n)]


def rows(names, h, c):
    return [(k, a, i, float(h[r, i]), float(c[i, r])) for r, (k, a) in enumerate(names) for i in range(h.shape[1])]


def test_survey_as_in_loops(spark):
    rng = np.random.default_rng(3)
    names = [(k, a) for k in range(2, 5) for a in range(k)]
    h = rng.random((len(names), 40)) + np.linspace(0, 2, 40) * rng.uniform(-0.6, 1, (len(names), 1))
    h[4] = 0.25  # no variation: no neighbours
    c = np.where(rng.random((40, len(names))) < 0.2, rng.random((40, len(names))), 0.0)
    for r in range(len(names)):
        c[h[r].argmax(), r] = 0.0 if r == 2 else 0.5
    h[5, [7, 9]] = h[5].max() + 1.0  # a tie of the largest weights and shares: the least id
    c[[7, 9], 5] = 0.75
    c[:, 6] = 1e-9  # too small to count
    tr, marks, many = looped(h, c)
    got = archetypes.survey(spark.createDataFrame(rows(names, h, c), TRACE)).orderBy("k", "arch").collect()
    assert [(r["k"], r["arch"]) for r in got] == names
    for r, t in zip(got, tr):
        assert (r["transitivity"] is None) == (t is None) and (t is None or math.isclose(r["transitivity"], t, rel_tol=1e-9))
    assert [r["landmark"] for r in got] == marks and marks[2] is None and marks[5] == 7
    assert [r["observations"] for r in got] == many
    known = np.array([t for t in tr if t is not None])
    z = [0.0 if t is None else (t - known.mean()) / known.std(ddof=1) for t in tr]
    assert np.allclose([r["z"] for r in got], z)
    want = [a for a, zz, m, n in zip(names, z, marks, many) if zz >= -1 and m is not None and n >= 3]
    t = spark.createDataFrame(rows(names, h, c), TRACE)
    assert archetypes.collect(t, -1.0, 3) == want and (2, 0) not in archetypes.collect(t, 9.0)
    # One undefined transitivity turns the test off for all.
    assert [r["z"] for r in archetypes.survey(t, compat=True).collect()] == [0.0] * len(names)


def test_survey_where_all_are_alike(spark):
    """In a clique every transitivity is 1 but for rounding, which is no difference."""
    rng = np.random.default_rng(4)
    h, names = np.linspace(0, 5, 30) + rng.random((5, 30)), [(2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]
    c = np.eye(30)[:, [29] * 5]
    got = archetypes.survey(spark.createDataFrame(rows(names, h, c), TRACE)).collect()
    assert np.allclose([r["transitivity"] for r in got], 1) and [r["z"] for r in got] == [0.0] * 5


def test_survey_of_nothing(spark):
    t = spark.createDataFrame([], TRACE)
    assert archetypes.survey(t).count() == 0 and archetypes.collect(t) == []


def test_schedule_leaves_out_what_never_acts(spark):
    g = spark.createDataFrame([(0, 1, 1.0), (1, 2, 0.5), (2, 0, 0.1), (0, 2, 0.09)], "src long, dst long, weight double")
    assert sorted(map(tuple, layout.schedule(g, 10).collect())) == [(0, 1, 1.0), (1, 2, 2.0), (2, 0, 10.0)]
    assert layout.schedule(g.limit(0), 10).count() == 0


def test_many_weights_are_those_of_one_by_one():
    from matloom.operators.simplex import solve, solve_many

    rng = np.random.default_rng(5)
    for m, k, n in ((8, 5, 60), (2, 7, 40), (12, 20, 20)):
        w = rng.normal(size=(m, k))
        b = np.concatenate([rng.normal(size=(n, m)) * rng.choice([0.1, 1, 3], size=(n, 1)), w.T])
        assert np.allclose(solve_many(w, b), np.stack([solve(w, x) for x in b]), atol=1e-10)


def test_picks_go_by_length_beyond_nine_places(spark):
    """Lengths that differ by less than the SQL once rounded to: the longer row comes first on both sides; equal rows by id."""
    import duckdb
    import pyarrow as pa

    from matloom.operators.simplex import spa
    from matloom.registry import ORACLES

    rows = [(i, [float(x) for x in y]) for i, y in enumerate(np.eye(7) * (1 + 1e-11 * np.arange(7))[:, None])]
    rows += [(i + 10, y) for i, y in rows]
    embeddings = pa.table({"vec_id": [i for i, _ in rows], "embedding": [y for _, y in rows], "label": [0] * len(rows)})
    got = [i for i, _ in spa(spark.createDataFrame(rows, "id long, vec array<double>"), 6)]
    assert got == [6, 5, 4, 3, 2, 1]
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    assert sorted(con.sql(ORACLES["spa"]).fetchall()) == list(enumerate(got))[1:]
