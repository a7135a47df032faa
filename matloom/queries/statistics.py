"""Queries of annotation, enrichment, autocorrelation and rank correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from matloom.operators import color, stats
from matloom.operators.graph import diffuse
from matloom.queries.base import E, H, S, V, brands, labels, long, parts, query, r6, simplex, vectors
from matloom.queries.graphs import G, R, net, normed
from matloom.sources.tables import table

L10 = "ln(10)"


def _weights(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.posexplode(F.array(F.col("s_acctbal") + 1000.0, F.col("s_nationkey") + 1.0, F.lit(1.0))).alias("dim", "value"))


def specific(h: str) -> str:
    return (
        f"WITH {S}, n AS (SELECT count(*)::DOUBLE AS n FROM supplier), m AS (SELECT count(*)::DOUBLE AS m FROM part), {h}, hs AS (SELECT id, dim, value / (sum(value) OVER (PARTITION BY dim) / n) AS value FROM hw, n), "
        "rw AS (SELECT row_id, avg(value) AS r, count(*) / any_value(n) AS f FROM s, n GROUP BY row_id), q AS (SELECT col_id AS id, count(*) / any_value(m) AS q FROM s, m GROUP BY col_id), "
        "ga AS (SELECT id, dim, value * q / (SELECT sum(q) / any_value(n) FROM q, n) AS g FROM hs JOIN q USING (id)), su AS (SELECT dim, sum(g) AS g1, sum(g * g) AS g2, max(g) AS a FROM ga GROUP BY dim), "
        "ob AS (SELECT row_id, dim, sum(s.value * hs.value) AS o FROM s JOIN hs ON id = col_id GROUP BY ALL), "
        "al AS (SELECT row_id, dim, r, a, coalesce(o, 0) AS o, coalesce(o, 0) - f * r * g1 AS lam, f * r * r * g2 AS nu FROM rw CROSS JOIN su LEFT JOIN ob USING (row_id, dim)) "
        f"SELECT row_id, dim, {R('o / (SELECT n FROM n)', 'profile')}, {R(f'CASE WHEN lam > 0 THEN lam * lam / (2 * (nu + lam * r * a / 3)) / {L10} ELSE 0 END', 'upper')}, {R(f'CASE WHEN lam < 0 THEN lam * lam / (2 * nu) / {L10} ELSE 0 END', 'lower')} FROM al"
    )


@query("specificity_H", specific("hw AS (SELECT s_suppkey AS id, 0 AS dim, s_acctbal + 1000.0 AS value FROM supplier UNION ALL SELECT s_suppkey, 1, s_nationkey + 1.0 FROM supplier UNION ALL SELECT s_suppkey, 2, 1.0 FROM supplier)"))
def specificity_h(spark, d):
    return r6(stats.specificity(parts(spark, d), _weights(spark, d), table(spark, d, "supplier").count(), table(spark, d, "part").count()), "profile", "upper", "lower")


@query("specificity_labels", specific("hw AS (SELECT s_suppkey AS id, (s_nationkey % 4)::INT AS dim, 1.0::DOUBLE AS value FROM supplier WHERE s_nationkey % 4 > 0)"))
def specificity_labels(spark, d):
    lab = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 4).alias("label"))
    return r6(stats.specificity(parts(spark, d), stats.label_weights(lab), table(spark, d, "supplier").count(), table(spark, d, "part").count()), "profile", "upper", "lower")


def vision(s: str, x: str, ids: str, m: str) -> str:
    return (
        f"m AS (SELECT {m} AS m), {x}, st AS (SELECT {s}.col_id AS id, x.col_id AS dim, sum({s}.value * x.value) AS stat FROM {s} JOIN x USING (row_id) GROUP BY ALL), de AS (SELECT col_id AS id, sum(value) / any_value(m) AS mu, count(*) AS k FROM {s}, m GROUP BY col_id), "
        f"va AS (SELECT id, any_value(mu) AS mu, (sum((value - mu) ** 2) + (any_value(m) - any_value(k)) * any_value(mu) ** 2) / (any_value(m) - 1) AS var FROM {s} JOIN de ON id = col_id, m GROUP BY id), se AS (SELECT col_id AS dim, sum(value) AS x1, sum(value * value) AS x2 FROM x GROUP BY col_id), "
        f"vis AS (SELECT i.id, se.dim, coalesce((coalesce(stat, 0) - mu * x1) / nullif(sqrt(var * x2), 0), 0) AS value FROM ({ids}) i CROSS JOIN se LEFT JOIN va ON va.id = i.id LEFT JOIN st ON st.id = i.id AND st.dim = se.dim)"
    )


XB = "x AS (SELECT p_partkey AS row_id, regexp_extract(p_brand, '([0-9]+)$', 1)::BIGINT AS col_id, 1.0::DOUBLE AS value FROM part)"


@query("marker_vision_0", f"WITH {S}, {vision('s', XB, 'SELECT s_suppkey AS id FROM supplier', '(SELECT count(*) FROM part)')} SELECT id, dim, {R('value', 'value')} FROM vis")
def marker_vision_0(spark, d):
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return r6(stats.signature(parts(spark, d), brands(spark, d), ids, table(spark, d, "part").count()), "value")


def spread(method: int, x0: str, tag: str) -> str:
    """Common table expressions ending in `t{tag}5` (id, dim, value): five steps of diffusion of the seeds x0 (a query), on the nodes v and edges net."""
    steps = [
        f"{normed(method, f'p{tag}')}, x{tag} AS (SELECT id, dim, value / sum(abs(value)) OVER (PARTITION BY dim) AS value FROM ({x0})), z{tag} AS (SELECT id, (CASE WHEN id IN (SELECT dst FROM net WHERE weight > 0) THEN 0.15 ELSE 1.0 END) / (SELECT count(*) FROM v) AS z FROM v), "
        f"gr{tag} AS (SELECT id, dim FROM v CROSS JOIN (SELECT DISTINCT dim FROM x{tag})), t{tag}0 AS (SELECT id, dim, coalesce(value, 0) AS value FROM gr{tag} LEFT JOIN x{tag} USING (id, dim))"
    ]
    for i in range(1, 6):
        b = f"{tag}{i}"
        steps.append(f"m{b} AS (SELECT dim, sum(z * value) AS s FROM t{tag}{i - 1} JOIN z{tag} USING (id) GROUP BY dim), w{b} AS (SELECT src AS id, dim, 0.85 * sum(weight * value) AS value FROM p{tag} JOIN t{tag}{i - 1} ON id = dst GROUP BY ALL), t{b} AS (SELECT id, dim, coalesce(w{b}.value, 0) + (SELECT count(*) FROM v) * coalesce(x{tag}.value, 0) * s AS value FROM gr{tag} LEFT JOIN w{b} USING (id, dim) LEFT JOIN x{tag} USING (id, dim) JOIN m{b} USING (dim))")
    return ", ".join(steps)


SH = "sh AS (SELECT dim::BIGINT AS row_id, id AS col_id, value FROM (SELECT id, unnest(vec) AS value, generate_subscripts(vec, 1) - 1 AS dim FROM h) WHERE value > 0)"
XM = "x AS (SELECT range AS row_id, range % 16 AS col_id, (1 + range)::DOUBLE AS value FROM range(64) WHERE range % 16 < 3)"
GH = G


def _expression(spark, d):
    return long(simplex(spark, d)).where("value > 0").select(F.col("dim").cast("long").alias("row_id"), F.col("id").alias("col_id"), "value")


def _markers(spark):
    return spark.range(64).where("id % 16 < 3").select(F.col("id").alias("row_id"), (F.col("id") % 16).alias("col_id"), (F.col("id") + 1.0).cast("double").alias("value"))


@query("marker_vision_diffused", f"WITH {GH}, {SH}, {vision('sh', XM, 'SELECT id FROM v', '64')}, {spread(2, 'SELECT id, dim, value FROM vis', 'a')} SELECT id, dim, {R('value', 'value')} FROM ta5")
def marker_vision_diffused(spark, d):
    g, nodes = net(spark, d)
    return r6(diffuse(g, nodes, stats.signature(_expression(spark, d), _markers(spark), nodes, 64), method=2), "value")


@query(
    "marker_stats",
    f"WITH {GH}, {SH}, {XM}, {spread(0, 'SELECT id, 0 AS dim, 1.0 AS value FROM v', 'a')}, {spread(2, 'SELECT col_id AS id, row_id AS dim, value FROM sh WHERE row_id IN (SELECT row_id FROM x)', 'b')}, "
    "ba AS (SELECT row_id, sum(value) AS b FROM sh GROUP BY row_id), wa AS (SELECT row_id, col_id, value * b / sum(b) OVER (PARTITION BY col_id) AS w FROM x JOIN ba USING (row_id)), wb AS (SELECT row_id, col_id, w / sqrt(sum(w * w) OVER (PARTITION BY col_id)) AS w FROM wa) "
    f"SELECT tb5.id, col_id AS set, {R('sum(w * CASE WHEN tb5.value > 0 THEN tb5.value * log2(tb5.value / ta5.value) ELSE 0 END)', 'value')} FROM tb5 JOIN ta5 ON ta5.id = tb5.id JOIN wb ON wb.row_id = tb5.dim GROUP BY ALL",
)
def marker_stats(spark, d):
    g, nodes = net(spark, d)
    return r6(stats.marker_scores(g, nodes, _expression(spark, d), _markers(spark)), "value")


ENRICH = (
    f"WITH {XB}, r AS (SELECT p_partkey AS row_id, p_retailprice AS score, row_number() OVER w - 1 AS r, sum(p_retailprice) OVER w AS a, sum(p_retailprice ** 2) OVER w AS q FROM part WINDOW w AS (ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING)), "
    "hi AS (SELECT col_id AS set, r, sum(score) OVER (PARTITION BY col_id ORDER BY r) AS o, a, q, count(*) OVER (PARTITION BY col_id) AS n, (count(*) OVER (PARTITION BY col_id))::DOUBLE / (SELECT count(*) FROM part) AS p FROM r JOIN x USING (row_id)), "
    "l AS (SELECT *, CASE WHEN o - a * p > 0 THEN (o - a * p) ** 2 / (2 * (q * p + (SELECT max(p_retailprice) FROM part) * (o - a * p) / 3)) ELSE 0 END AS l FROM hi) "
    f"SELECT set, {R('CASE WHEN n > 1 THEN l ELSE 0 END', 'logp')}, CASE WHEN n > 1 THEN r ELSE 0 END AS threshold FROM l QUALIFY row_number() OVER (PARTITION BY set ORDER BY l DESC, r) = 1"
)


@query("set_enrichment", ENRICH)
def set_enrichment(spark, d):
    scores = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    return r6(stats.set_enrichment(scores, brands(spark, d)), "logp")


ENRICH_MATRIX = (
    f"WITH {XB}, c AS (SELECT p_partkey AS row_id, 0 AS dim, p_retailprice AS score FROM part UNION ALL SELECT p_partkey, 1, p_size::DOUBLE FROM part UNION ALL SELECT p_partkey, 2, (p_partkey % 97)::DOUBLE FROM part), "
    "r AS (SELECT *, row_number() OVER w - 1 AS r, sum(score) OVER w AS a, sum(score ** 2) OVER w AS q, max(score) OVER (PARTITION BY dim) AS top FROM c WINDOW w AS (PARTITION BY dim ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING)), "
    "hi AS (SELECT dim, col_id AS set, r, sum(score) OVER (PARTITION BY dim, col_id ORDER BY r) AS o, a, q, top, count(*) OVER (PARTITION BY dim, col_id) AS n, (count(*) OVER (PARTITION BY dim, col_id))::DOUBLE / (SELECT count(*) FROM part) AS p FROM r JOIN x USING (row_id)), "
    "l AS (SELECT *, CASE WHEN o - a * p > 0 THEN (o - a * p) ** 2 / (2 * (q * p + top * (o - a * p) / 3)) ELSE 0 END AS l FROM hi) "
    f"SELECT dim, set, {R('CASE WHEN n > 1 THEN l ELSE 0 END', 'logp')}, CASE WHEN n > 1 THEN r ELSE 0 END AS threshold FROM l QUALIFY row_number() OVER (PARTITION BY dim, set ORDER BY l DESC, r) = 1"
)


@query("set_enrichment_matrix", ENRICH_MATRIX)
def set_enrichment_matrix(spark, d):
    """Three columns of scores at once."""
    p = table(spark, d, "part")
    scores = p.select(F.col("p_partkey").alias("id"), F.posexplode(F.array(F.col("p_retailprice"), F.col("p_size").cast("double"), (F.col("p_partkey") % 97).cast("double"))).alias("dim", "value"))
    return r6(stats.set_enrichments(scores, brands(spark, d)), "logp")


EV = "e AS (SELECT id, unnest(vec) AS value, (generate_subscripts(vec, 1) - 1)::INT AS dim FROM v)"
ZX = "xx AS (SELECT id, dim, coalesce((value - avg(value) OVER (PARTITION BY dim)) / nullif(stddev_samp(value) OVER (PARTITION BY dim), 0), 0) AS value FROM e)"
CX = "xx AS (SELECT id, dim, value - avg(value) OVER (PARTITION BY dim) AS value FROM e)"
GX = "gx AS (SELECT a.dim, sum(weight * a.value * b.value) AS gx FROM net JOIN xx a ON a.id = src JOIN xx b ON b.id = dst AND a.dim = b.dim GROUP BY a.dim), sx AS (SELECT dim, sum(value ** 2) AS x2, sum(value ** 4) AS x4 FROM xx GROUP BY dim), k AS (SELECT (SELECT count(*) FROM v)::DOUBLE AS n, (SELECT sum(weight) FROM net) AS w)"
DX = "dx AS (SELECT dim, sum(d * value ** 2) AS dx FROM xx JOIN (SELECT dst AS id, sum(weight) AS d FROM net GROUP BY dst) USING (id) GROUP BY dim)"


def _scores(spark, d):
    return long(vectors(spark, d))


def _n(spark, d):
    return vectors(spark, d).count()


@query("moran_stat", f"WITH {G}, {EV}, {ZX}, {GX} SELECT dim, {R('n * gx / (w * x2)', 'stat')} FROM gx JOIN sx USING (dim), k")
def moran_stat(spark, d):
    return r6(stats.moran(net(spark, d)[0], _scores(spark, d), _n(spark, d)), "stat")


@query(
    "moran_parametric",
    f"WITH {G}, {EV}, {CX}, {GX}, bo AS (SELECT src, dst, sum(weight) AS w FROM (SELECT src, dst, weight FROM net UNION ALL SELECT dst, src, weight FROM net) GROUP BY ALL), s AS (SELECT (SELECT 0.5 * sum(w * w) FROM bo) AS s1, (SELECT sum(t * t) FROM (SELECT sum(w) AS t FROM bo GROUP BY src)) AS s2), "
    "mo AS (SELECT dim, n * gx / (w * x2) AS stat, -1.0 / (n - 1) AS mu, n * ((n * (n - 3) + 3) * s1 - n * s2 + 3 * w * w) / ((n - 1) * (n - 2) * (n - 3) * w * w) - (n * (n - 1) * s1 - 2 * n * s2 + 6 * w * w) * ((x4 / n) / (x2 / n) ** 2) / ((n - 1) * (n - 2) * (n - 3) * w * w) - 1.0 / (n - 1) ** 2 AS var FROM gx JOIN sx USING (dim), k, s) "
    f"SELECT dim, {R('stat', 'stat')}, {R('(stat - mu) / sqrt(var)', 'z')}, {R('mu', 'mu')}, {R('sqrt(var)', 'sigma')} FROM mo",
)
def moran_parametric(spark, d):
    return r6(stats.moran_parametric(net(spark, d)[0], _scores(spark, d), _n(spark, d)), "stat", "z", "mu", "sigma")


@query("geary_stat", f"WITH {G}, {EV}, {ZX}, {GX}, {DX} SELECT dim, {R('(n - 1) * (dx - gx) / (2 * w * x2)', 'stat')}, {R('(n - 1) * (dx - gx) / (w * x2)', 'classic')} FROM gx JOIN sx USING (dim) JOIN dx USING (dim), k")
def geary_stat(spark, d):
    return r6(stats.geary(net(spark, d)[0], _scores(spark, d), _n(spark, d)), "stat", "classic")


def drawn(what: str) -> str:
    less = "dx.dx - " if what == "geary" else ""
    pd = "pd AS (SELECT perm, dim, sum(d * value ** 2) AS dx FROM px JOIN (SELECT dst AS id, sum(weight) AS d FROM net GROUP BY dst) USING (id) GROUP BY ALL), " if what == "geary" else ""
    raw = "SELECT perm, dim, pd.dx - pg.gx AS gx FROM pg JOIN pd USING (perm, dim)" if what == "geary" else "SELECT * FROM pg"
    real = "gx JOIN dx USING (dim)" if what == "geary" else "gx"
    factor = "(n - 1) / (2 * w * x2)" if what == "geary" else "n / (w * x2)"
    return (
        f"WITH {G}, {EV}, {ZX}, {GX}, {DX}, pl AS (SELECT id, row_number() OVER (ORDER BY id) AS place FROM v), dr AS (SELECT id AS own, perm, row_number() OVER (PARTITION BY perm ORDER BY md5('0:' || perm || ':' || id)) AS place FROM v CROSS JOIN (SELECT range AS perm FROM range(1, 31))), "
        "px AS MATERIALIZED (SELECT own AS id, perm, dim, value FROM dr JOIN pl USING (place) JOIN xx ON xx.id = pl.id), pg AS (SELECT a.perm, a.dim, sum(weight * a.value * b.value) AS gx FROM net JOIN px a ON a.id = src JOIN px b ON b.id = dst AND a.dim = b.dim AND a.perm = b.perm GROUP BY ALL), "
        f"{pd}mo AS (SELECT dim, avg(gx) AS mu, stddev_samp(gx) AS sigma FROM ({raw}) GROUP BY dim) "
        f"SELECT dim, {R(f'({less}gx.gx) * {factor}', 'stat')}, {R(f'{-1 if what == chr(103) + chr(101) + chr(97) + chr(114) + chr(121) else 1} * ({less}gx.gx - mu) / sigma', 'z')}, {R('mu', 'mu')}, {R('sigma', 'sigma')} FROM {real} JOIN sx USING (dim) JOIN mo USING (dim), k"
    )


for w in ("moran", "geary"):
    query(f"{w}_perm", drawn(w))(lambda spark, d, w=w: r6(stats.permuted(net(spark, d)[0], _scores(spark, d), _n(spark, d), w), "stat", "z", "mu", "sigma"))


def chatterjee(cols: str) -> str:
    return (
        f"WITH {E}, n AS (SELECT count(*)::DOUBLE AS n FROM v), pr AS (SELECT a.dim AS i, b.dim AS j, a.id, a.value AS x, b.value AS y FROM e a JOIN e b USING (id) WHERE {cols}), "
        "f AS (SELECT *, (rank() OVER (PARTITION BY i, j ORDER BY y) + count(*) OVER (PARTITION BY i, j, y) - 1) / n AS f, (rank() OVER (PARTITION BY i, j ORDER BY y DESC) + count(*) OVER (PARTITION BY i, j, y) - 1) / n AS g FROM pr, n), "
        "s AS (SELECT *, abs(f - lead(f) OVER (PARTITION BY i, j ORDER BY x, id)) AS step, row_number() OVER w AS k, sum(f) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM f WINDOW w AS (PARTITION BY i, j ORDER BY f, id)), "
        "t AS (SELECT i, j, any_value(n) AS n, sum(step) / (2 * any_value(n)) AS a1, avg(g * (1 - g)) AS cu, avg((2 * n - 2 * k + 1) * f * f) / any_value(n) AS ai, avg((2 * n - 2 * k + 1) * f) / any_value(n) AS ci, avg(((cum + (n - k) * f) / n) ** 2) AS bb FROM s GROUP BY ALL) "
        f"SELECT i, j, {R('1 - a1 / cu', 'xi')}, {R('sqrt(n) * (1 - a1 / cu) / sqrt((ai - 2 * bb + ci * ci) / (cu * cu))', 'z')} FROM t"
    )


def _pairs(spark, d, left: str, right: str):
    e = _scores(spark, d)
    a = e.where(left).select("id", F.col("dim").alias("i"), F.col("value").alias("x"))
    b = e.where(right).select("id", F.col("dim").alias("j"), F.col("value").alias("y"))
    return a.join(b, "id")


@query("xicor", chatterjee("a.dim = 0 AND b.dim = 1"))
def xicor(spark, d):
    return r6(stats.xicor(_pairs(spark, d, "dim = 0", "dim = 1"), _n(spark, d)), "xi", "z")


@query("xicor_matrix", chatterjee("true"))
def xicor_matrix(spark, d):
    """Every component with every component."""
    return r6(stats.xicor_matrix(_scores(spark, d), _scores(spark, d), _n(spark, d)), "xi", "z")


@query("rank1_match", "WITH u AS (SELECT c_custkey AS u_id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank FROM customer WHERE c_acctbal > 0), w AS (SELECT s_suppkey AS v_id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS rank FROM supplier WHERE s_acctbal > 0) SELECT rank, u_id, v_id FROM u JOIN w USING (rank)")
def rank1_match(spark, d):
    u = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    v = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"))
    return stats.rank_one_match(u, v)


LAB = "lab AS (SELECT p_partkey AS id, (p_size * 2)::DOUBLE AS l, (p_partkey % 161 - 80)::DOUBLE AS a, (p_partkey % 141 - 70)::DOUBLE AS b FROM part)"


@query("lab_to_rgb", f"WITH {LAB}, {color.rgb_sql('lab')} SELECT id, {R('r', 'r')}, {R('g', 'g')}, {R('b', 'b')} FROM rgb")
def lab_to_rgb(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 2.0).alias("l"), (F.col("p_partkey") % 161 - 80).cast("double").alias("a"), (F.col("p_partkey") % 141 - 70).cast("double").alias("b"))
    return r6(color.rgb(p), "r", "g", "b")
