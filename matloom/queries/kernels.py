"""Queries of decompositions, archetypes, matching and layout. Where rows cannot be written in SQL, facts that follow from them are."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from matloom.operators import archetypes, color, convex, factors, layout, linalg, matching, simplex, sparse
from matloom.queries.base import E, S, V, parts, query, r6, vectors
from matloom.plans.materialize import cut
from matloom.queries.graphs import G, R, net
from matloom.sources.tables import table


def powers(matrix: str) -> str:
    """SQL of p, value: the p-th root of the sum of the singular values' 2p-th powers, p = 1 to 4, of a matrix (id, dim, value), through traces of powers of its products."""
    return (
        f"m AS MATERIALIZED ({matrix}), gm AS MATERIALIZED (SELECT a.dim AS i, b.dim AS j, sum(a.value * b.value) AS g FROM m a JOIN m b USING (id) GROUP BY ALL), g2 AS MATERIALIZED (SELECT a.i, b.j, sum(a.g * b.g) AS g FROM gm a JOIN gm b ON a.j = b.i GROUP BY ALL), "
        "tr AS (SELECT 1 AS p, sum(g) AS t FROM gm WHERE i = j UNION ALL SELECT 2, sum(g * g) FROM gm UNION ALL SELECT 3, sum(gm.g * g2.g) FROM gm JOIN g2 USING (i, j) UNION ALL SELECT 4, sum(g * g) FROM g2), "
        "pw AS (SELECT p::INT AS p, round(t ** (1.0 / p), 6) AS value FROM tr)"
    )


def _powers(values) -> list[tuple[int, float]]:
    return [(p, round(float((values ** (2 * p)).sum() ** (1 / p)), 6)) for p in (1, 2, 3, 4)]


def _decomposed(spark, d, algorithm):
    """All singular values, by sums of their powers, and whether left and right vectors are orthonormal, which makes them the vectors of these values."""
    v = vectors(spark, d)
    got = linalg.svd(v, len(v.first()["vec"]), algorithm)
    right = linalg.gram(got.right(v)).products
    good = [bool(np.allclose(x, np.eye(len(got.values)), atol=1e-6)) for x in (got.left.T @ got.left, right)]
    return spark.createDataFrame([(algorithm, p, x, *good) for p, x in _powers(got.values)], "algorithm string, p int, value double, left_unit boolean, right_unit boolean")


for name in ("irlb", "halko", "feng"):
    query(f"svd_{name}", f"WITH {E}, {powers('SELECT id, dim, value FROM e')} SELECT '{name}' AS algorithm, p, value, true AS left_unit, true AS right_unit FROM pw")(lambda spark, d, name=name: _decomposed(spark, d, name))


@query("singular_values")
def singular_values(spark, d):
    """The ten largest, by each algorithm."""
    v = vectors(spark, d)
    rows = [(a, i, round(float(s), 6)) for a in ("irlb", "halko", "feng") for i, s in enumerate(linalg.svd(v, 10, a, rounds=20).values)]
    return spark.createDataFrame(rows, "algorithm string, i int, value double")


def _sold(spark, d):
    """Brand x supplier: quantities, in ten thousands. Few entries of few values each, whatever the number of lines."""
    t = parts(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("long").alias("brand")), "row_id")
    return t.groupBy(F.col("brand").alias("row_id"), "col_id").agg((F.sum("value") / 10000.0).alias("value"))


SOLD = (
    f"{S}, bq AS (SELECT regexp_extract(p_brand, '([0-9]+)$', 1)::BIGINT AS dim, col_id AS id, sum(value) / 10000.0 AS value FROM s JOIN part ON p_partkey = row_id GROUP BY ALL), "
    "e AS MATERIALIZED (SELECT id, dim, coalesce(value, 0) AS value FROM (SELECT DISTINCT id FROM bq) CROSS JOIN (SELECT DISTINCT dim FROM bq) LEFT JOIN bq USING (id, dim))"
)


@query("svd_sparse", f"WITH {SOLD}, {powers('SELECT id, dim, value FROM e')} SELECT p, value, true AS left_unit, true AS right_unit FROM pw")
def svd_sparse(spark, d):
    """All singular values of brand x supplier by restarted bidiagonalisation, and whether both sides' vectors are orthonormal."""
    got = sparse.svd(_sold(spark, d), 1 << 20)
    good = [bool(np.allclose(linalg.gram(x).products, np.eye(len(got.values)), atol=1e-6)) for x in (got.left, got.right)]
    return spark.createDataFrame([(p, x, *good) for p, x in _powers(got.values)], "p int, value double, left_unit boolean, right_unit boolean")


@query(
    "svd_sparse_first",
    f"WITH RECURSIVE {S}, pv AS (SELECT 0 AS i, col_id, 1.0::DOUBLE AS v FROM (SELECT DISTINCT col_id FROM s) UNION ALL "
    "SELECT i + 1, b.col_id, sum(b.value * u) AS v FROM (SELECT i, a.row_id, sum(a.value * v) AS u FROM pv JOIN s a USING (col_id) WHERE i < 16 GROUP BY ALL) JOIN s b USING (row_id) GROUP BY ALL), "
    "pu AS (SELECT row_id, sum(s.value * v) AS u FROM pv JOIN s USING (col_id) WHERE i = 16 GROUP BY row_id) "
    f"SELECT row_id, {R('u / sqrt(sum(u * u) OVER ())', 'u')} FROM pu",
)
def svd_sparse_first(spark, d):
    """The first left vector of part x supplier."""
    got = sparse.svd(parts(spark, d), 1)
    return r6(got.left.select(F.col("id").alias("row_id"), F.col("vec")[0].alias("u")), "u")


@query("perturbed_svd", f"WITH {E}, {powers('SELECT id, dim, value - avg(value) OVER (PARTITION BY id) AS value FROM e')} SELECT p, value FROM pw")
def perturbed_svd(spark, d):
    """The decomposition after taking every vector's mean out: its values."""
    v = vectors(spark, d)
    old = linalg.svd(v, 64)
    m = old.left.shape[0]
    mean = np.full((m, 1), 1 / np.sqrt(m))
    got = linalg.perturbed(v, old, mean, -mean, np.zeros(1))
    return spark.createDataFrame(_powers(got.values), "p int, value double")


def without(profile: str) -> str:
    """SQL of the vectors less their part along a profile (dim, a), and less their mean then."""
    return f"SELECT id, dim, r - avg(r) OVER (PARTITION BY id) AS value FROM (SELECT id, dim, value - a * sum(a * value) OVER (PARTITION BY id) AS r FROM e JOIN ({profile}) USING (dim))"


AVERAGE = "SELECT dim, mu / sqrt(sum(mu * mu) OVER ()) AS a FROM (SELECT dim, avg(value) AS mu FROM e GROUP BY dim)"


@query("reduce_kernel", f"WITH {E}, m AS MATERIALIZED ({without(AVERAGE)}) SELECT x.id, {R('sum(x.value * x.value)', 'norm2')}, {R('sum(x.value * y.value)', 'dot')} FROM m x JOIN m y ON x.dim = y.dim AND y.id = 0 GROUP BY x.id")
def reduce_kernel(spark, d):
    """At full rank and without rounding, reduced rows keep all products of the centred vectors: with themselves, and with the first."""
    v = vectors(spark, d)
    got = linalg.reduce_kernel(v, 64, grid=0.0).reduced
    first = F.array(*[F.lit(float(x)) for x in got.where("id = 0").first()["vec"]])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return r6(got.select("id", dot("vec", "vec").alias("norm2"), dot(F.col("vec"), first).alias("dot")), "norm2", "dot")


def eigen(xs: str) -> str:
    """Common table expressions that end in `uo` (k, u, l), the eigenvectors and values of the 3 x 3 products of the table `xs` (id, x0, x1, x2), which are roots of a cubic, and `pr` (id, k, x), the rows' products with them."""
    pairs = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]
    sums = ", ".join(f"sum(x{i} * x{j}) AS g{i}{j}" for i, j in pairs)
    rows = [("g00 - l", "g01", "g02"), ("g01", "g11 - l", "g12"), ("g02", "g12", "g22 - l")]
    cross = lambda a, b: f"[({a[1]}) * ({b[2]}) - ({a[2]}) * ({b[1]}), ({a[2]}) * ({b[0]}) - ({a[0]}) * ({b[2]}), ({a[0]}) * ({b[1]}) - ({a[1]}) * ({b[0]})]"
    tries = " UNION ALL ".join(f"SELECT k, {cross(rows[i], rows[j])} AS u FROM ev" for i, j in ((0, 1), (0, 2), (1, 2)))
    heavy = lambda f: f"list_sum(list_transform(u, lambda y: pow({f}(y, 0), 2)))"
    return (
        f"{xs}, gm AS (SELECT {sums} FROM xs), q0 AS (SELECT *, (g00 + g11 + g22) / 3 AS q FROM gm), "
        "q1 AS (SELECT *, sqrt((pow(g00 - q, 2) + pow(g11 - q, 2) + pow(g22 - q, 2) + 2 * (g01 * g01 + g02 * g02 + g12 * g12)) / 6) AS p FROM q0), "
        "q2 AS (SELECT *, acos(greatest(-1, least(1, ((g00 - q) * ((g11 - q) * (g22 - q) - g12 * g12) - g01 * (g01 * (g22 - q) - g12 * g02) + g02 * (g01 * g12 - (g11 - q) * g02)) / (2 * p * p * p)))) / 3 AS phi FROM q1), "
        "ev AS MATERIALIZED (SELECT *, q + 2 * p * cos(phi + CASE k WHEN 0 THEN 0 WHEN 1 THEN 4 * pi() / 3 ELSE 2 * pi() / 3 END) AS l FROM q2, range(3) n(k)), "
        f"us AS (SELECT k, arg_max(list_transform(u, lambda y: y / sqrt(list_inner_product(u, u))), list_inner_product(u, u)) AS u FROM ({tries}) WHERE list_inner_product(u, u) > 0 GROUP BY k), uo AS MATERIALIZED (SELECT k, list_transform(u, lambda y: y * CASE WHEN {heavy('greatest')} < {heavy('least')} THEN -1 ELSE 1 END) AS u, l FROM us JOIN ev USING (k)), "
        "pr AS (SELECT id, k, x0 * u[1] + x1 * u[2] + x2 * u[3] AS x, l FROM xs, uo)"
    )


@query(
    "reduce_kernel_rounded",
    f"WITH {eigen(E.replace('unnest(vec)', 'unnest(vec[1:3])').replace('generate_subscripts(vec, 1)', 'generate_subscripts(vec[1:3], 1)') + f', r3 AS MATERIALIZED ({without(AVERAGE)}), xs AS MATERIALIZED (SELECT id, max(value) FILTER (dim = 0) AS x0, max(value) FILTER (dim = 1) AS x1, max(value) FILTER (dim = 2) AS x2 FROM r3 GROUP BY id)')} "
    f"SELECT id, k::INT AS k, {R('round(x / sqrt(l) * sqrt(n) / 0.01) * 0.01 / sqrt(n) * sqrt(l)', 'x')} FROM pr, (SELECT count(*)::DOUBLE AS n FROM v) WHERE k < 2",
)
def reduce_kernel_rounded(spark, d):
    """Reduced rows of the first three components at full rank and the default rounding: two values each, the third is zero."""
    got = linalg.reduce_kernel(vectors(spark, d).select("id", F.slice("vec", 1, 3).alias("vec")), 3).reduced
    return r6(got.select("id", F.posexplode(F.slice("vec", 1, 2)).alias("k", "x")), "x")


@query("reduce_kernel_sparse", f"WITH {SOLD}, {powers(without(AVERAGE))} SELECT p, value FROM pw")
def reduce_kernel_sparse(spark, d):
    """The values of the reduced kernel of brand x supplier, at full rank."""
    t = _sold(spark, d)
    got = sparse.reduce_kernel(t, *[t.select(F.col(c).alias("id")).distinct() for c in ("row_id", "col_id")], 1 << 20, grid=0.0)
    return spark.createDataFrame(_powers(got.values), "p int, value double")


def _reduced(spark, d, k=8):
    return linalg.reduce_kernel(vectors(spark, d), k).reduced


BATCH = "SELECT dim, t / sqrt(sum(t * t) OVER ()) AS a FROM (SELECT dim, sum(value) AS t FROM e JOIN (SELECT id, label FROM v) USING (id) WHERE label = 0 GROUP BY dim)"


@query("orthogonalize_batch", f"WITH {E}, {powers(without(BATCH))} SELECT p, value FROM pw")
def orthogonalize_batch(spark, d):
    """The profile of the vectors with label 0 taken out."""
    v = vectors(spark, d)
    design = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array((F.col("label") == 0).cast("double")).alias("vec"))
    return spark.createDataFrame(_powers(linalg.orthogonalize_batch(v, linalg.svd(v, 64), design).values), "p int, value double")


@query("orthogonalize_basal", f"WITH {E}, {powers('SELECT id, dim, r - avg(r) OVER (PARTITION BY id) AS value FROM (SELECT id, dim, CASE WHEN dim < 2 THEN 0.0 ELSE value END AS r FROM e)')} SELECT p, value FROM pw")
def orthogonalize_basal(spark, d):
    """The first two components taken out."""
    v = vectors(spark, d)
    return spark.createDataFrame(_powers(linalg.orthogonalize_basal(v, linalg.svd(v, 64), np.eye(64)[:, :2]).values), "p int, value double")


def _spa_sql(k: int) -> str:
    dot = "list_inner_product({}, {})"
    steps = [f"r0 AS (SELECT id, vec AS r, {dot.format('vec', 'vec')} AS size FROM v)"]
    for i in range(k):
        steps.append(f"p{i} AS (SELECT id, list_transform(r, lambda x: x / sqrt({dot.format('r', 'r')})) AS u FROM r{i} ORDER BY {dot.format('r', 'r')} DESC, size DESC, id LIMIT 1), r{i + 1} AS (SELECT r{i}.id, size, list_transform(list_zip(r, u), lambda z: z[1] - z[2] * {dot.format('r', 'u')}) AS r FROM r{i}, p{i})")
    return f"WITH {V}, {', '.join(steps)} " + " UNION ALL ".join(f"SELECT {i} AS pick, id FROM p{i}" for i in range(1, k))


@query("spa", _spa_sql(6))
def spa(spark, d):
    """The picks after the first."""
    return spark.createDataFrame([(i, a) for i, (a, _) in enumerate(simplex.spa(vectors(spark, d), 6)) if i], "pick int, id long")


def _optimal(rows, w: np.ndarray):
    """`rows` (x: weights, vec) with whether x lies on the simplex, and whether no weight can move to bring W x nearer to vec."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    row = lambda values: F.array(*[F.lit(float(z)) for z in values])
    g = w.T @ w
    got = rows.withColumn("g", F.array(*[dot(F.col("x"), row(g[k])) - dot(F.col("vec"), row(w[:, k])) for k in range(w.shape[1])]))
    total = F.aggregate("x", F.lit(0.0), lambda s, z: s + z)
    return got.withColumn("simplex", (F.abs(total - 1) < 1e-9) & (F.array_min("x") >= 0)).withColumn("optimal", F.array_min("g") >= dot(F.col("x"), F.col("g")) - 1e-6)


@query("simplex_regression", f"WITH {V} SELECT id, true AS simplex, true AS optimal FROM v")
def simplex_regression(spark, d):
    """Weights of every vector on six of them: on the simplex, and no weight can move to lower the distance."""
    v = vectors(spark, d)
    w = np.array([r["vec"] for r in v.where("id < 6").orderBy("id").collect()]).T
    got = simplex.regression(v, w).withColumnRenamed("vec", "x").join(v, "id")
    return _optimal(got, w).select("id", "simplex", "optimal")


@query("archetype_trace", f"WITH {V} SELECT k::INT AS k, arch::INT AS arch, (SELECT count(*) FROM v) AS n, true AS mixes, true AS weighs FROM range(2, 6) a(k), range(0, 5) b(arch) WHERE arch < k")
def archetype_trace(spark, d):
    """For each archetype: how many observations it has weights for, whether its own mixture sums to one, and whether weights lie in [0, 1]."""
    t = archetypes.trace(_reduced(spark, d), 2, 5, rounds=10)
    return t.groupBy("k", "arch").agg(F.count(F.lit(1)).alias("n"), (F.abs(F.sum("c") - 1) < 1e-6).alias("mixes"), ((F.min("h") >= 0) & (F.max("h") <= 1)).alias("weighs"))


@query("aa", f"WITH {V} SELECT k::INT AS k, id, true AS simplex, true AS optimal FROM v, range(2, 6) a(k)")
def aa(spark, d):
    """For each number of archetypes, made anew from the observations they are mixtures of: every observation's weights are the best ones."""
    v = _reduced(spark, d)
    t = archetypes.trace(v, 2, 5, rounds=10)
    made = t.where("c > 0").join(v.select("id", F.posexplode("vec").alias("dim", "x")), "id").groupBy("k", "arch", "dim").agg(F.sum(F.col("c") * F.col("x")).alias("w")).collect()
    out = None
    for k in range(2, 6):
        w = np.zeros((8, k))
        for r in made:
            if r["k"] == k:
                w[r["dim"], r["arch"]] = r["w"]
        rows = archetypes.stacked(t.where(F.col("k") == k)).withColumnRenamed("vec", "x").join(v, "id")
        got = _optimal(rows, w).select(F.lit(k).alias("k"), "id", "simplex", "optimal")
        out = got if out is None else out.union(got)
    return out


@query("archetype_passes", f"WITH {V} SELECT 3::INT AS k, arch::INT AS arch, (SELECT count(*) FROM v) AS n, true AS mixes, true AS weighs FROM range(0, 3) b(arch)")
def archetype_passes(spark, d):
    """Three archetypes fitted by passes over the rows."""
    t = archetypes.trace(_reduced(spark, d), 3, 3, rounds=2, passes=True)
    return t.groupBy("k", "arch").agg(F.count(F.lit(1)).alias("n"), (F.abs(F.sum("c") - 1) < 1e-6).alias("mixes"), ((F.min("h") >= 0) & (F.max("h") <= 1)).alias("weighs"))


@query("frank_wolfe", f"WITH {V} SELECT DISTINCT label, true AS simplex, true AS optimal FROM v")
def frank_wolfe(spark, d):
    """Each label's mean vector, twice as long, as a combination of all vectors: weights on the simplex, and no vector that weight could move to."""
    v = cut(vectors(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id"), "rows")
    means = v.select("label", F.posexplode("vec").alias("dim", "x")).groupBy("label", "dim").agg((2 * F.avg("x")).alias("x"))
    rows = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("vec")).orderBy("label").collect()
    targets = np.array([r["vec"] for r in rows]).T
    got = convex.frank_wolfe(v, targets, tol=1e-7)
    least = [F.min(F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(z)) for z in a.point() - targets[:, t]]), lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)).alias(f"s{t}") for t, a in enumerate(got)]
    lows = v.agg(*least).first()
    out = [(r["label"], bool((a.weights >= 0).all() and abs(a.weights.sum() - 1) < 1e-9), bool(lows[t] >= (a.point() - targets[:, t]) @ a.point() - 1e-6)) for t, (r, a) in enumerate(zip(rows, got))]
    return spark.createDataFrame(out, "label int, simplex boolean, optimal boolean")


@query(
    "coreset",
    f"WITH {E}, mu AS (SELECT dim, avg(value) AS mu FROM e GROUP BY dim), fa AS (SELECT id, sum((value - mu) * (value - mu)) AS far FROM e JOIN mu USING (dim) GROUP BY id), "
    "pr AS (SELECT id, 0.5 / count(*) OVER () + 0.5 / sum(far) OVER () * far AS p FROM fa) "
    f"SELECT id, {R('1.0 / (100 * p)', 'weight')} FROM pr ORDER BY -ln((('0x' || substr(md5('0:' || id), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / p, id LIMIT 100",
)
def coreset(spark, d):
    return r6(convex.coreset(vectors(spark, d), 100).select("id", "weight"), "weight")


@query("under_factors", f"WITH {S} SELECT DISTINCT col_id AS id, true AS below, true AS smaller FROM s JOIN part ON p_partkey = row_id")
def under_factors(spark, d):
    """Two factors of supplier x brand that stay below it, and whether what is left falls."""
    t = _sold(spark, d)
    brands = t.select("row_id").distinct().withColumnRenamed("row_id", "brand")
    grid = t.select(F.col("col_id").alias("id")).distinct().join(F.broadcast(brands), F.lit(True))  # a brand each
    full = grid.join(t.select(F.col("col_id").alias("id"), F.col("row_id").alias("brand"), "value"), ["id", "brand"], "left")
    v = cut(full.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("brand", F.coalesce("value", F.lit(0.0)).alias("x")))), lambda e: e["x"]).alias("vec")), "sold")
    got = factors.underapproximations(v, 2, rounds=5, strict=True)
    f = got.features * got.weights
    above = F.array(*[sum((F.lit(float(x)) * F.col("y")[k] for k, x in enumerate(row)), F.lit(0.0)) for row in f])
    both = v.join(got.observations.withColumnRenamed("vec", "y"), "id").select("id", F.arrays_zip("vec", above.alias("f")).alias("z"))
    return both.select("id", F.forall("z", lambda z: z["f"] <= z["vec"] + 1e-12).alias("below"), F.lit(bool(got.rest[1] <= got.rest[0] < 1)).alias("smaller"))


def _stack(spark, d, k_max):
    """A trace of 2 to k_max archetypes: weights from the components of the vectors, one after the other, shares from components two deviations above their mean."""
    v = vectors(spark, d)
    rows, at = [], 0
    for k in range(2, k_max + 1):
        up = [F.greatest(F.col("vec")[at + i], F.lit(0.0)) for i in range(k)]
        total = sum(up[1:], up[0])
        rows += [F.struct(F.lit(k).alias("k"), F.lit(i).alias("arch"), F.col("vec")[at + i].alias("x"), (up[i] / F.when(total > 0, total).otherwise(1.0)).alias("h")) for i in range(k)]
        at += k
    long = v.select("id", F.inline(F.array(*rows)))
    far = long.join(long.groupBy("k", "arch").agg((F.avg("x") + 2 * F.stddev_samp("x")).alias("far")), ["k", "arch"]).withColumn("over", F.greatest(F.col("x") - F.col("far"), F.lit(0.0)))
    sums = far.groupBy("k", "arch").agg(F.sum("over").alias("total"))
    return cut(far.join(sums, ["k", "arch"]).select("k", "arch", "id", "h", F.when(F.col("total") > 0, F.col("over") / F.col("total")).otherwise(0.0).alias("c")), "stack")


def surveyed(k_max: int, least_z: float, least_obs: int) -> str:
    """Common table expressions that end in `sv`: what each archetype of the stack survives by."""
    at = [(k, i, k * (k - 1) // 2 - 1) for k in range(2, k_max + 1) for i in range(k)]
    h = ", ".join(f"({k}, {i}, {o + i}, {o}, {o + k - 1})" for k, i, o in at)
    return (
        f"{E}, names(k, arch, dim, low, high) AS (VALUES {h}), x AS MATERIALIZED (SELECT k, arch, id, value AS x, greatest(value, 0) / CASE WHEN t > 0 THEN t ELSE 1 END AS h FROM names JOIN e USING (dim) "
        "JOIN (SELECT k, id, sum(greatest(value, 0)) AS t FROM (SELECT DISTINCT k, low, high FROM names) JOIN e ON dim BETWEEN low AND high GROUP BY ALL) USING (k, id)), "
        "ov AS MATERIALIZED (SELECT *, greatest(x - avg(x) OVER w - 2 * stddev_samp(x) OVER w, 0) AS over FROM x WINDOW w AS (PARTITION BY k, arch)), "
        "t AS MATERIALIZED (SELECT k, arch, id, h, CASE WHEN sum(over) OVER w > 0 THEN over / sum(over) OVER w ELSE 0 END AS c FROM ov WINDOW w AS (PARTITION BY k, arch)), "
        "b AS MATERIALIZED (SELECT a.k, a.arch, b.k AS k2, b.arch AS arch2, corr(a.h, b.h) AS w FROM t a JOIN t b USING (id) WHERE (a.k, a.arch) <> (b.k, b.arch) GROUP BY ALL HAVING corr(a.h, b.h) > 0), "
        "tri AS (SELECT p.k, p.arch, sum((p.w + q.w) / 2) AS s FROM b p JOIN b q ON (p.k, p.arch) = (q.k, q.arch) JOIN b r ON (r.k, r.arch) = (p.k2, p.arch2) AND (r.k2, r.arch2) = (q.k2, q.arch2) GROUP BY ALL), "
        "tv AS (SELECT k, arch, CASE WHEN n > 1 THEN coalesce(s, 0) / (strength * (n - 1)) END AS transitivity FROM names LEFT JOIN (SELECT k, arch, sum(w) AS strength, count(*) AS n FROM b GROUP BY ALL) USING (k, arch) LEFT JOIN tri USING (k, arch)), "
        "tz AS (SELECT *, coalesce((transitivity - avg(transitivity) OVER ()) / nullif(stddev_samp(transitivity) OVER (), 0), 0) AS z FROM tv), "
        "lm AS (SELECT k, arch, arg_max(id, (c, -id)) FILTER (top - h < 1e-3 AND c > 0) AS landmark, count(*) FILTER (c > 1e-6) AS observations FROM (SELECT *, max(h) OVER (PARTITION BY k, arch) AS top FROM t) GROUP BY ALL), "
        f"sv AS MATERIALIZED (SELECT *, coalesce(z >= {least_z} AND landmark IS NOT NULL AND observations >= {least_obs}, false) AS kept FROM tz JOIN lm USING (k, arch))"
    )


@query("archetype_survey", f"WITH {surveyed(6, -1.0, 10)} SELECT k::INT AS k, arch::INT AS arch, {R('transitivity', 'transitivity')}, {R('z', 'z')}, landmark, observations, kept FROM sv")
def archetype_survey(spark, d):
    """What each archetype of the stack is kept or pruned by, and whether `collect` keeps it."""
    t = _stack(spark, d, 6)
    kept = spark.createDataFrame([(*a, True) for a in archetypes.collect(t, -1.0, 10)], "k int, arch int, kept boolean")
    return r6(archetypes.survey(t).join(F.broadcast(kept), ["k", "arch"], "left").withColumn("kept", F.coalesce("kept", F.lit(False))), "transitivity", "z")


def _merged_sql() -> str:
    dot = "list_inner_product(r, {})"
    steps = [
        surveyed(4, -1.0, 10),
        "th AS MATERIALIZED (SELECT k * 10 + arch AS i, id, h / CASE WHEN sum(h) OVER (PARTITION BY id) > 0 THEN sum(h) OVER (PARTITION BY id) ELSE 1 END AS h, c FROM t JOIN sv USING (k, arch) WHERE kept)",
        "r0 AS MATERIALIZED (SELECT j, list(x ORDER BY i) AS r FROM (SELECT a.i, b.i AS j, sum(a.h * b.c) AS x FROM th a JOIN th b USING (id) GROUP BY ALL) GROUP BY j)",
    ]
    for i in range(9):
        steps.append(
            f"p{i} AS MATERIALIZED (SELECT {i} AS pick, j, sqrt({dot.format('r')}) AS size, list_transform(r, lambda x: x / sqrt({dot.format('r')})) AS u FROM r{i} WHERE {dot.format('r')} > 1e-20 ORDER BY {dot.format('r')} DESC, j LIMIT 1), "
            f"r{i + 1} AS MATERIALIZED (SELECT r{i}.j, list_transform(list_zip(r, u), lambda z: z[1] - z[2] * {dot.format('u')}) AS r FROM r{i}, p{i})"
        )
    steps.append("pk AS (" + " UNION ALL ".join(f"SELECT pick, j, size FROM p{i}" for i in range(9)) + ")")
    return (
        f"WITH {', '.join(steps)} SELECT pick::INT AS pick, (j // 10)::INT AS k, (j % 10)::INT AS arch, dim, {R('sum(c * value)', 'w')} FROM pk JOIN th ON i = j JOIN e USING (id) "
        "WHERE pick < (SELECT floor(sum(size) * sum(size) / sum(size * size) + 0.5) FROM pk) GROUP BY ALL"
    )


def _merged(spark, d):
    t = _stack(spark, d, 4)
    return archetypes.merge(vectors(spark, d), t, archetypes.collect(t, -1.0, 10))


@query("archetype_profiles", _merged_sql())
def archetype_profiles(spark, d):
    """The archetypes that merging keeps of the stack's survivors, in their order, and their profiles."""
    got = _merged(spark, d)
    return r6(spark.createDataFrame([(p, k, a, dim, float(x)) for p, (k, a) in enumerate(got.kept) for dim, x in enumerate(got.profiles[:, p])], "pick int, k int, arch int, dim int, w double"), "w")


@query("archetype_weights", f"WITH {V} SELECT id, true AS simplex, true AS optimal, true AS largest FROM v")
def archetype_weights(spark, d):
    """Every vector's weights on the merged archetypes: the best ones, and its label has the largest."""
    got = _merged(spark, d)
    rows = got.weights.withColumnRenamed("vec", "x").join(vectors(spark, d), "id").join(got.labels, "id")
    return _optimal(rows, got.profiles).select("id", "simplex", "optimal", (F.col("x")[F.col("label")] == F.array_max("x")).alias("largest"))


@query("archetype_collect")
def archetype_collect(spark, d):
    t = archetypes.trace(_reduced(spark, d), 2, 6, rounds=10)
    return spark.createDataFrame(archetypes.collect(t), "k int, arch int")


@query("archetype_merge")
def archetype_merge(spark, d):
    v = _reduced(spark, d)
    t = archetypes.trace(v, 2, 6, rounds=10)
    got = archetypes.merge(v, t, archetypes.collect(t))
    return spark.createDataFrame(got.kept, "k int, arch int")


@query("archetype_pipeline")
def archetype_pipeline(spark, d):
    return archetypes.pipeline(_reduced(spark, d), 2, 6, rounds=10).labels


def _matched() -> str:
    """SQL of the best total by trying all: with five columns, each needs its five best rows only."""
    names = [f"c{i}" for i in range(5)]
    apart = " AND ".join(f"{a}.r <> {b}.r" for i, a in enumerate(names) for b in names[:i])
    sides = " CROSS JOIN ".join(f"(SELECT r, w FROM best WHERE c = {i} UNION ALL SELECT -1 - {i}, 0) {n}" for i, n in enumerate(names))
    return (
        "WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS c FROM (SELECT DISTINCT event_type FROM events)), w AS (SELECT user_id AS r, c, count(*)::DOUBLE AS w FROM events JOIN k USING (event_type) GROUP BY ALL), "
        f"best AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY c ORDER BY w DESC, r) <= 5) SELECT max({' + '.join(n + '.w' for n in names)}) AS total, 5::BIGINT AS pairs, true AS apart FROM {sides} WHERE {apart}"
    )


@query("hungarian", _matched())
def hungarian(spark, d):
    """Users and event types, by how often they meet: the matched weights' total, and whether every user and every type is matched once."""
    e = table(spark, d, "events")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())
    col = F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")) - 1
    got = matching.hungarian(e.groupBy(F.col("user_id").alias("row_id"), col.alias("col_id")).agg(F.count(F.lit(1)).cast("double").alias("value")))
    return got.agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("pairs"), ((F.count_distinct("row_id") == F.count(F.lit(1))) & (F.count_distinct("col_id") == F.count(F.lit(1)))).alias("apart"))


@query("layout_schedule", f"WITH {G} SELECT src, dst, {R('top / weight', 'every')} FROM net, (SELECT max(weight) AS top FROM net) WHERE weight >= top / 8")
def layout_schedule(spark, d):
    """The edges that act in eight epochs, and how often."""
    return r6(layout.schedule(net(spark, d)[0], 8), "every")


def _pulled_sql(epochs: int, a: float, b: float) -> str:
    """Epochs of attraction with Adam's steps at its defaults, one table after the other."""
    steps = [f"{G}, sc AS MATERIALIZED (SELECT src, dst, top / weight AS every FROM net, (SELECT max(weight) AS top FROM net) WHERE weight >= top / {epochs})", "s0 AS (SELECT id, vec[1] AS x, vec[2] AS y, 0.0::DOUBLE AS mx, 0.0::DOUBLE AS my, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy FROM v)"]
    for e in range(epochs):
        pull = lambda c: f"sum(2 * greatest(-4, least(4, f * (p{c} - q{c})))) AS g{c}"
        move = lambda c: f"{c} + {1 - e / epochs!r} * (m{c} / {1 - 0.5 ** (e + 1)!r}) / (sqrt(v{c} / {1 - 0.9 ** (e + 1)!r}) + 1e-7) AS {c}"
        steps += [
            f"d{e} AS (SELECT src, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy, pow(p.x - q.x, 2) + pow(p.y - q.y, 2) AS d FROM sc JOIN s{e} p ON p.id = src JOIN s{e} q ON q.id = dst WHERE floor({e + 1} / every + 1e-9) > floor({e} / every + 1e-9))",
            f"g{e} AS (SELECT src AS id, {pull('x')}, {pull('y')} FROM (SELECT *, CASE WHEN d > 0 THEN {-2 * a * b!r} * pow(d, {b - 1!r}) / (1 + {a!r} * pow(d, {b!r})) ELSE 0 END AS f FROM d{e}) GROUP BY src)",
            f"m{e} AS (SELECT id, x, y, 0.5 * mx + 0.5 * coalesce(gx, 0) AS mx, 0.5 * my + 0.5 * coalesce(gy, 0) AS my, 0.9 * vx + {1 - 0.9!r} * coalesce(gx * gx, 0) AS vx, 0.9 * vy + {1 - 0.9!r} * coalesce(gy * gy, 0) AS vy FROM s{e} LEFT JOIN g{e} USING (id))",
            f"s{e + 1} AS MATERIALIZED (SELECT id, {move('x')}, {move('y')}, mx, my, vx, vy FROM m{e})",
        ]
    return f"WITH {', '.join(steps)} SELECT id, {R('x', 'x')}, {R('y', 'y')} FROM s{epochs}"


@query("layout_pull", _pulled_sql(4, 1.5, 0.9))
def layout_pull(spark, d):
    """Places after four epochs over the tables, without what is random (nodes to be pushed from)."""
    g, _ = net(spark, d)
    got = layout.layout(g, vectors(spark, d), "umap", epochs=4, a=1.5, b=0.9, negatives=0, rounds=True)
    return r6(got.select("id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")), "x", "y")


for method in layout.METHODS:

    def laid(spark, d, method=method):
        g, _ = net(spark, d)
        return layout.layout(g, vectors(spark, d), method).select("id", F.size("vec").alias("components"))

    query(f"layout_{method}", f"WITH {V} SELECT id, 2 AS components FROM v")(laid)


@query("node_colors", f"WITH {V} SELECT id, true AS inside FROM v")
def node_colors(spark, d):
    got = color.node_colors(vectors(spark, d))
    inside = [(F.col(c) >= 0) & (F.col(c) <= 1) for c in ("r", "g", "b")]
    return got.select("id", (inside[0] & inside[1] & inside[2]).alias("inside"))


@query(
    "node_colors_values",
    f"WITH {eigen(V + ', xs AS MATERIALIZED (SELECT id, vec[1] AS x0, vec[2] AS x1, vec[3] AS x2 FROM v)')}, pc AS (SELECT id, k, (x - avg(x) OVER (PARTITION BY k)) / stddev_samp(x) OVER (PARTITION BY k) AS z FROM pr), wd AS (SELECT id, max(z) FILTER (k = 0) AS z0, max(z) FILTER (k = 1) AS z1, max(z) FILTER (k = 2) AS z2 FROM pc GROUP BY id), "
    f"lab AS (SELECT id, 25 + 70 * (z2 - min(z2) OVER ()) / (max(z2) OVER () - min(z2) OVER ()) AS l, 75 * z0 AS a, 75 * z1 AS b FROM wd), {color.rgb_sql('lab')} SELECT id, {R('r', 'r')}, {R('g', 'g')}, {R('b', 'b')} FROM rgb",
)
def node_colors_values(spark, d):
    """Colours from the first three components as coordinates."""
    return r6(color.node_colors(vectors(spark, d).select("id", F.slice("vec", 1, 3).alias("vec"))), "r", "g", "b")
