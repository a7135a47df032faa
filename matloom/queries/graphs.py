"""Queries of neighbour graphs, graph norms, diffusion, labels and cores."""

from __future__ import annotations

from pyspark.sql import functions as F

from matloom import functions
from matloom.operators import coo, density, fuzzy, graph, knn
from matloom.queries.base import E, H, V, labels, long, query, r6, simplex, vectors
from matloom.plans.materialize import cut


def R(e: str, name: str) -> str:
    return f"round({e}, 6) + 0.0 AS {name}"


JSD = "sqrt(greatest(0, list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: 0.5 * CASE WHEN z[1] > 0 THEN z[1] * log2(z[1]) ELSE 0 END + 0.5 * CASE WHEN z[2] > 0 THEN z[2] * log2(z[2]) ELSE 0 END - CASE WHEN z[1] + z[2] > 0 THEN (z[1] + z[2]) / 2 * log2((z[1] + z[2]) / 2) ELSE 0 END))) + 0.5 * greatest(0, 1 - list_sum(a.vec)) + 0.5 * greatest(0, 1 - list_sum(b.vec)))"
DIST = {"l2": "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))", "ip": "1 - list_inner_product(a.vec, b.vec)", "jsd": JSD}


def near(metric: str, k: str) -> str:
    t = "h" if metric == "jsd" else "v"
    return f"{H}, p AS MATERIALIZED (SELECT a.id, b.id AS nbr, {DIST[metric]} AS d FROM {t} a JOIN {t} b ON a.id <> b.id), nn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nbr) AS pos FROM p QUALIFY pos <= {k})"


def weights(metric: str) -> str:
    top = "1.0" if metric == "jsd" else "max(d) OVER (PARTITION BY dst)"
    return f"g AS MATERIALIZED (SELECT src, dst, greatest(1e-7, {top} - d) AS weight FROM dir WHERE d <> 0)"


MUTUAL = "SELECT a.src, a.dst, sqrt(a.weight * b.weight) AS weight FROM g a JOIN g b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst"
UNION = "SELECT src, dst, sum(weight) / 2 AS weight FROM (SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g) WHERE src <> dst GROUP BY src, dst"


def kstar(metric: str, final: str = MUTUAL) -> str:
    """Common table expressions that end in `net`."""
    k = "least((SELECT count(*) FROM v) - 1, 5 * floor(sqrt((SELECT count(*) FROM v)) + 0.5)::INT)"
    return (
        f"{near(metric, k)}, r AS (SELECT *, sum(d) OVER w AS s1, sum(d * d) OVER w AS s2 FROM nn WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)), "
        "l AS (SELECT *, CASE WHEN pos + s1 * s1 - pos * s2 < 0 THEN 0 ELSE (s1 + sqrt(greatest(0, pos + s1 * s1 - pos * s2))) / pos END - d < 0 AS neg FROM r), "
        f"c AS (SELECT *, coalesce(min(CASE WHEN neg THEN pos END) OVER (PARTITION BY id) - 2, {k} - 1) AS last FROM l), "
        f"dir AS MATERIALIZED (SELECT nbr AS src, id AS dst, d FROM c WHERE pos <= last), {weights(metric)}, net AS MATERIALIZED ({final})"
    )


def fixed(metric: str, keep: str = "true") -> str:
    return f"{near(metric, '9')}, dir AS MATERIALIZED (SELECT id AS src, nbr AS dst, d FROM nn WHERE {keep}), {weights(metric)}, net AS MATERIALIZED ({MUTUAL})"


EDGES = f"SELECT src, dst, {R('weight', 'weight')} FROM net"


def _of(spark, d, metric):
    return simplex(spark, d) if metric == "jsd" else vectors(spark, d)


for m in ("l2", "ip", "jsd"):
    query(f"kstar_{m}", f"WITH {kstar(m)} {EDGES}")(lambda spark, d, m=m: r6(knn.build(_of(spark, d, m), "k*nn", m), "weight"))
    query(f"knn_{m}", f"WITH {fixed(m)} {EDGES}")(lambda spark, d, m=m: r6(knn.build(_of(spark, d, m), "knn", m), "weight"))

    def to_centres(spark, d, m=m):
        """Distance of every vector to every label's mean vector: the few means are streamed past all blocks of rows."""
        v = _of(spark, d, m)
        mean = long(v).join(labels(spark, d), "id").groupBy("label", "dim").agg(F.avg("value").alias("value"))
        centres = mean.groupBy(F.col("label").cast("long").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("vec"))
        return r6(knn.neighbours(v, centres.count(), m, centres).select("id", F.col("nbr").alias("label"), "dist"), "dist")

    t = "h" if m == "jsd" else "v"
    centres = f"ce AS (SELECT label, dim, avg(value) AS value FROM (SELECT id, unnest(vec) AS value, generate_subscripts(vec, 1) AS dim FROM {t}) JOIN (SELECT id, label FROM v) USING (id) GROUP BY ALL), cv AS (SELECT label, list(value ORDER BY dim) AS vec FROM ce GROUP BY label)"
    query(f"{m}_pairs", f"WITH {H}, {centres} SELECT a.id, b.label::BIGINT AS label, {R(DIST[m], 'dist')} FROM {t} a CROSS JOIN cv b")(to_centres)

def _halves(v):
    return v.where("id % 2 = 0"), v.where("id % 2 = 1")


@query("bipartite_kstar", kstar("l2").replace("ON a.id <> b.id", "ON a.id % 2 = 0 AND b.id % 2 = 1").replace("(SELECT count(*) FROM v) - 1", "(SELECT count(*) FROM v WHERE id % 2 = 1)").replace("sqrt((SELECT count(*) FROM v))", "sqrt((SELECT count(*) FROM v WHERE id % 2 = 1))").join(["WITH ", f" SELECT src, dst, {R('weight', 'weight')} FROM g"]))
def bipartite_kstar(spark, d):
    """Vectors of odd ids as neighbours of those of even ids."""
    return r6(knn.bipartite(*_halves(vectors(spark, d)), "l2"), "weight")


@query("knn_cells")
def knn_cells(spark, d):
    """The ten nearest from cells around centres, for a recall of 0.95, as for tables too large for every pair; tests measure the recall."""
    return r6(knn.approximate(vectors(spark, d), 10, "l2").select("id", "nbr", "pos", "dist"), "dist")


@query("knn_descent")
def knn_descent(spark, d):
    """The ten nearest by neighbours of neighbours; tests measure the recall."""
    return r6(knn.descend(vectors(spark, d), 10, "l2").select("id", "nbr", "pos", "dist"), "dist")


#: The width of every node by halving an interval, 60 times.
WIDTHS = (
    "nd AS (SELECT id, min(d) AS rho, log2(count(*) + 1) AS target, count(*) AS k FROM nn GROUP BY id), "
    "ws AS (SELECT 0 AS i, id, 0.0::DOUBLE AS low, NULL::DOUBLE AS high, 1.0::DOUBLE AS width FROM nd UNION ALL "
    "SELECT i + 1, id, CASE WHEN got > target THEN low ELSE width END, CASE WHEN got > target THEN width ELSE high END, "
    "CASE WHEN got > target THEN (low + width) / 2 WHEN high IS NULL THEN width * 2 ELSE (width + high) / 2 END "
    "FROM (SELECT i, id, low, high, width, target, sum(exp(-(d - rho) / width)) AS got FROM ws JOIN nd USING (id) JOIN nn USING (id) WHERE i < 60 GROUP BY ALL)), "
    "fw AS (SELECT nn.nbr AS src, nn.id AS dst, exp(-(nn.d - rho) / greatest(width, 0.001 * avg(nn.d) OVER (PARTITION BY nn.id))) AS weight FROM nn JOIN nd USING (id) JOIN (SELECT id, width FROM ws WHERE i = 60) USING (id))"
)


@query(
    "fuzzy_graph",
    f"WITH RECURSIVE {near('l2', '15')}, {WIDTHS}, fb AS (SELECT src, dst, weight FROM fw UNION ALL SELECT dst, src, weight FROM fw) "
    f"SELECT src, dst, {R('CASE WHEN count(*) = 2 THEN sum(weight) - max(weight) * min(weight) ELSE sum(weight) END', 'weight')} FROM fb GROUP BY src, dst",
)
def fuzzy_graph(spark, d):
    """Fifteen neighbours as a fuzzy set, and the union of both directions."""
    near = knn.neighbours(vectors(spark, d), 15, "l2")
    return r6(fuzzy.fuzzy_union(fuzzy.smooth_weights(near, tol=1e-12)), "weight")


@query(
    "placed_points",
    f"WITH {kstar('l2').replace('ON a.id <> b.id', 'ON a.id % 2 = 0 AND b.id % 2 = 1').replace('(SELECT count(*) FROM v) - 1', '(SELECT count(*) FROM v WHERE id % 2 = 1)').replace('sqrt((SELECT count(*) FROM v))', 'sqrt((SELECT count(*) FROM v WHERE id % 2 = 1))')}, "
    "pl AS (SELECT g.dst AS id, sum(g.weight * v.vec[1]) / sum(abs(g.weight)) AS x, sum(g.weight * v.vec[2]) / sum(abs(g.weight)) AS y FROM g JOIN v ON v.id = g.src GROUP BY g.dst) "
    f"SELECT id, {R('x', 'x')}, {R('y', 'y')} FROM pl",
)
def placed_points(spark, d):
    """Vectors of even ids among their neighbours of odd ids, which stand at their first two components."""
    new, old = _halves(vectors(spark, d))
    g = knn.bipartite(new, old, "l2").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    at = fuzzy.placed(g, old.select("id", F.slice("vec", 1, 2).alias("vec")))
    return r6(at.select("id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y")), "x", "y")


query("kstar_union", f"WITH {kstar('l2', UNION)} {EDGES}")(lambda spark, d: r6(knn.adaptive(vectors(spark, d), "l2", mutual=False), "weight"))
query("knn_compat", f"WITH {fixed('l2', 'pos + 1 > 5')} {EDGES}")(lambda spark, d: r6(knn.fixed(vectors(spark, d), 10, "l2", farthest=True), "weight"))
query("sym_mutual", f"WITH {fixed('l2')} {EDGES}")(lambda spark, d: r6(coo.symmetric(knn.fixed(vectors(spark, d), 10, "l2", directed=True), True), "weight"))
query("sym_mean", f"WITH {fixed('l2').replace(MUTUAL, UNION)} {EDGES}")(lambda spark, d: r6(coo.symmetric(knn.fixed(vectors(spark, d), 10, "l2", directed=True), False), "weight"))


def net(spark, d):
    """The adaptive graph of the embeddings, written once, and its nodes."""
    return cut(knn.adaptive(vectors(spark, d), "l2"), "graph"), vectors(spark, d).select("id")


G = kstar("l2")


def normed(method: int, name: str = "pn") -> str:
    if method == 2:
        return f"{name} AS (SELECT src, dst, weight / sqrt(CASE WHEN r = 0 THEN 1 ELSE r END * CASE WHEN c = 0 THEN 1 ELSE c END) AS weight FROM net JOIN (SELECT src, sum(weight) AS r FROM net GROUP BY src) USING (src) JOIN (SELECT dst, sum(weight) AS c FROM net GROUP BY dst) USING (dst))"
    by = "dst" if method == 0 else "src"
    return f"{name} AS (SELECT src, dst, weight / sum(abs(weight)) OVER (PARTITION BY {by}) AS weight FROM net UNION ALL SELECT id, id, 1.0 FROM v WHERE id NOT IN (SELECT {by} FROM net))"


for k in (0, 1, 2):
    query(f"graph_norm_{k}", f"WITH {G}, {normed(k)} SELECT src, dst, {R('weight', 'weight')} FROM pn")(lambda spark, d, k=k: r6(coo.normalize_graph(*net(spark, d), k), "weight"))


def _seeds(spark, d):
    """One column of seeds for each label: ones on its vectors."""
    return labels(spark, d).select("id", F.col("label").alias("dim"), F.lit(1.0).alias("value"))


def walk(method: int) -> str:
    steps = [f"x0 AS (SELECT id, label AS dim, 1.0 / count(*) OVER (PARTITION BY label) AS value FROM v), z AS (SELECT id, (CASE WHEN id IN (SELECT dst FROM net WHERE weight > 0) THEN 0.15 ELSE 1.0 END) / (SELECT count(*) FROM v) AS z FROM v), grid AS (SELECT id, dim FROM v CROSS JOIN (SELECT DISTINCT dim FROM x0)), t0 AS (SELECT id, dim, coalesce(value, 0) AS value FROM grid LEFT JOIN x0 USING (id, dim))"]
    for i in range(1, 6):
        steps.append(f"m{i} AS (SELECT dim, sum(z * value) AS s FROM t{i - 1} JOIN z USING (id) GROUP BY dim), w{i} AS (SELECT src AS id, dim, 0.85 * sum(weight * value) AS value FROM pn JOIN t{i - 1} ON id = dst GROUP BY ALL), t{i} AS (SELECT id, dim, coalesce(w{i}.value, 0) + (SELECT count(*) FROM v) * coalesce(x0.value, 0) * s AS value FROM grid LEFT JOIN w{i} USING (id, dim) LEFT JOIN x0 USING (id, dim) JOIN m{i} USING (dim))")
    return f"{G}, {normed(method)}, " + ", ".join(steps)


for k in (0, 1, 2):
    query(f"pagerank_{k}", f"WITH {walk(k)} SELECT id, dim, {R('value', 'value')} FROM t5")(lambda spark, d, k=k: r6(functions.network_diffusion(*net(spark, d), _seeds(spark, d), method=k), "value"))


def cheb() -> str:
    c = 0.85
    steps = [f"{G}, {normed(0)}, grid AS (SELECT id, dim FROM v CROSS JOIN (SELECT DISTINCT label AS dim FROM v)), x0 AS (SELECT grid.id, dim, CASE WHEN label = dim THEN 1.0 ELSE 0.0 END AS value FROM grid JOIN v USING (id)), y0 AS (SELECT * FROM x0), y1 AS (SELECT grid.id, dim, {c} * coalesce(w, 0) + {1 - c} * x0.value AS value FROM grid JOIN x0 USING (id, dim) LEFT JOIN (SELECT src AS id, dim, sum(weight * value) AS w FROM pn JOIN x0 ON id = dst GROUP BY ALL) USING (id, dim))"]
    m0, m1 = 1.0, 1 / c
    for i in range(2, 7):
        m = 2 * m1 / c - m0
        steps.append(f"y{i} AS (SELECT grid.id, dim, {2 * m1 / m!r} * coalesce(w, 0) - {m0 / m!r} * a.value + {2 * m1 / (c * m) * (1 - c)!r} * x0.value AS value FROM grid JOIN x0 USING (id, dim) JOIN y{i - 2} a USING (id, dim) LEFT JOIN (SELECT src AS id, dim, sum(weight * value) AS w FROM pn JOIN y{i - 1} ON id = dst GROUP BY ALL) USING (id, dim))")
        m0, m1 = m1, m
    return ", ".join(steps)


@query(
    "pagerank_limit",
    f"WITH RECURSIVE {G}, pc AS (SELECT src, dst, weight / sum(abs(weight)) OVER (PARTITION BY dst) AS weight FROM net), "
    "wy AS (SELECT 0 AS i, id, label AS dim, 1.0 / count(*) OVER (PARTITION BY label) AS value FROM v UNION ALL SELECT i + 1, src, dim, 0.85 * sum(weight * value) FROM wy JOIN pc ON dst = id WHERE i < 200 GROUP BY i, src, dim), "
    "ws AS (SELECT id, dim, 0.15 * sum(value) AS value FROM wy GROUP BY ALL) "
    f"SELECT id, dim, {R('coalesce(value, 0)', 'value')} FROM (SELECT id, dim FROM v CROSS JOIN (SELECT DISTINCT label AS dim FROM v)) LEFT JOIN ws USING (id, dim)",
)
def pagerank_limit(spark, d):
    """The walks' limits by a linear solve; the SQL sums up 200 rounds."""
    return r6(graph.diffuse_solved(*net(spark, d), _seeds(spark, d)), "value")


query("pagerank_cheb", f"WITH {cheb()} SELECT id, dim, {R('greatest(value, 0)', 'value')} FROM y6")(lambda spark, d: r6(functions.network_diffusion(*net(spark, d), _seeds(spark, d), approx=True, tol=0.0), "value"))


def enriched(w: str, lab: str, at: str = "") -> str:
    """Common table expressions ending in `en{at}` (id, label, l), of weights w (src, dst, weight) and labels lab (id, label)."""
    return (
        f"ps{at} AS (SELECT label, count(*)::DOUBLE / (SELECT count(*) FROM v) AS p FROM {lab} WHERE label >= 0 GROUP BY label), ob{at} AS (SELECT src AS id, label, sum(weight) AS o FROM {w} JOIN {lab} ON id = dst WHERE label >= 0 GROUP BY ALL), "
        f"ro{at} AS (SELECT src AS id, sum(weight) AS r, sum(weight * weight) AS q, max(weight) AS a FROM {w} GROUP BY src), "
        f"en{at} AS (SELECT id, label, CASE WHEN o - r * p > 0 THEN (o - r * p) ** 2 / (2 * (q * p + a * (o - r * p) / 3)) ELSE 0 END AS l FROM ob{at} JOIN ro{at} USING (id) JOIN ps{at} USING (label))"
    )


@query("graph_enrichment", f"WITH {G}, {enriched('net', 'v')} SELECT id, label, {R('l', 'score')} FROM en WHERE l > 0")
def graph_enrichment(spark, d):
    g, nodes = net(spark, d)
    return r6(graph.label_enrichment(g, labels(spark, d), nodes).select("id", "label", "score").where("score > 0"), "score")


def lpa() -> str:
    steps = [f"{G}, {normed(1)}, tn AS (SELECT src, dst, weight * (SELECT count(*) FROM v) AS weight FROM pn), l0 AS (SELECT id, CASE WHEN id % 3 = 0 THEN label ELSE -1 END AS label FROM v)"]
    for i in range(1, 4):
        steps.append(f"{enriched('tn', f'l{i - 1}', str(i))}, b{i} AS (SELECT id, label, l FROM en{i} WHERE l > 3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY l DESC, label) = 1), l{i} AS (SELECT pv.id, CASE WHEN st.label >= 0 THEN st.label WHEN b{i}.label IS NOT NULL THEN b{i}.label ELSE pv.label END AS label FROM l{i - 1} pv LEFT JOIN b{i} USING (id) JOIN l0 st ON st.id = pv.id)")
    return ", ".join(steps)


@query("lpa_3", f"WITH {lpa()} SELECT id, label FROM l3")
def lpa_3(spark, d):
    """Labels of every third vector, which stay fixed, spread over the graph."""
    g, nodes = net(spark, d)
    start = labels(spark, d).select("id", F.when(F.col("id") % 3 == 0, F.col("label")).otherwise(-1).alias("label"))
    return graph.propagate(g, nodes, start, fixed=start.where("label >= 0").select("id"))


def cores(edges: str, nodes: str, rounds: int = 40) -> str:
    steps = [f"ed AS (SELECT DISTINCT src, dst FROM {edges}), c0 AS (SELECT id, count(dst) AS c FROM {nodes} LEFT JOIN ed ON src = id GROUP BY id)"]
    for i in range(1, rounds + 1):
        steps.append(f"c{i} AS MATERIALIZED (SELECT id, coalesce(h, 0) AS c FROM c{i - 1} LEFT JOIN (SELECT src AS id, max(least(c, rn)) AS h FROM (SELECT src, c, row_number() OVER (PARTITION BY src ORDER BY c DESC) AS rn FROM ed JOIN c{i - 1} ON id = dst) GROUP BY src) USING (id))")
    return ", ".join(steps)


@query("coreness", f"WITH {G}, {cores('net', 'v')} SELECT id, c::BIGINT AS core FROM c40")
def coreness(spark, d):
    return graph.coreness(*net(spark, d))


@query("centrality", f"WITH {G}, inner_net AS (SELECT src, dst FROM net JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE a.label = b.label), {cores('inner_net', 'v')} SELECT id, {R('c / CASE WHEN coalesce(stddev_samp(c) OVER (PARTITION BY label), 0) = 0 THEN 1 ELSE stddev_samp(c) OVER (PARTITION BY label) END', 'centrality')} FROM c40 JOIN v USING (id)")
def centrality(spark, d):
    return r6(graph.centrality(net(spark, d)[0], labels(spark, d)), "centrality")


def regions(least: int, eps: str) -> str:
    """Common table expressions that end in `lab` (id, label, core), by the order of core numbers spread for three rounds."""
    steps = [f"{G}, {normed(0)}, {cores('net', 'v')}, x0 AS (SELECT id, c / (SELECT sum(c) FROM c40) AS value FROM c40), z AS (SELECT id, (CASE WHEN id IN (SELECT dst FROM net WHERE weight > 0) THEN 0.15 ELSE 1.0 END) / (SELECT count(*) FROM v) AS z FROM v), t0 AS (SELECT id, value FROM x0)"]
    for i in range(1, 4):
        steps.append(f"w{i} AS (SELECT src AS id, 0.85 * sum(weight * value) AS value FROM pn JOIN t{i - 1} ON id = dst GROUP BY ALL), t{i} AS (SELECT x0.id, coalesce(w{i}.value, 0) + (SELECT count(*) FROM v) * x0.value * (SELECT sum(z * value) FROM t{i - 1} JOIN z USING (id)) AS value FROM x0 LEFT JOIN w{i} USING (id))")
    return ", ".join(steps) + (
        f", pl AS (SELECT id, row_number() OVER (ORDER BY value DESC, id) AS place FROM t3), hv AS MATERIALIZED (SELECT src, dst FROM net WHERE weight > {eps}), co AS MATERIALIZED (SELECT src AS id FROM hv GROUP BY src HAVING count(*) >= {least}), "
        "inr AS MATERIALIZED (SELECT src, dst FROM hv WHERE src IN (SELECT id FROM co) AND dst IN (SELECT id FROM co)), re AS (SELECT id, id AS root FROM co UNION SELECT inr.dst, re.root FROM re JOIN inr ON inr.src = re.id), "
        "cm AS (SELECT id, min(root) AS comp FROM re GROUP BY id), nb AS (SELECT comp, row_number() OVER (ORDER BY min(place)) AS label FROM cm JOIN pl USING (id) GROUP BY comp), cl AS (SELECT id, label FROM cm JOIN nb USING (comp)), "
        "bs AS (SELECT dst AS id, min(label) AS label FROM hv JOIN cl ON cl.id = hv.src GROUP BY dst), "
        "lab AS (SELECT v.id, coalesce(cl.label, bs.label, 0)::INT AS label, cl.label IS NOT NULL AS core FROM v LEFT JOIN cl USING (id) LEFT JOIN bs ON bs.id = v.id)"
    )


@query("dense_regions", f"WITH RECURSIVE {regions(4, '1.0')} SELECT id, label, core FROM lab")
def dense_regions(spark, d):
    return graph.dense_regions(*net(spark, d), least=4, eps=1.0)


@query("density_clusters")
def density_clusters(spark, d):
    """Clusters of all vectors by density; tests hold them against the definition."""
    return r6(density.hdbscan(vectors(spark, d), 4, 5), "probability", "outlier")


#: The tree's weight by taking the nearest row outside again and again is no single query; how many of its edges are lighter than a bound is: rows less components.
TREE = (
    f"{V}, td AS MATERIALIZED (SELECT a.id AS a, b.id AS b, sqrt({DIST['l2']}) AS d FROM v a JOIN v b ON a.id <> b.id), tc AS (SELECT a AS id, d AS core FROM td QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 3), "
    "tw AS MATERIALIZED (SELECT a, b, greatest(d, x.core, y.core) AS w FROM td JOIN tc x ON x.id = a JOIN tc y ON y.id = b), bo AS (SELECT unnest([1.12, 1.15, 1.18]) AS bound), "
    "tr AS (SELECT bound, id AS node, id AS root FROM v, bo UNION SELECT tr.bound, tw.b, tr.root FROM tr JOIN tw ON tw.a = tr.node AND tw.w <= tr.bound)"
)


@query("density_tree", f"WITH RECURSIVE {TREE} SELECT bound::DOUBLE AS bound, ((SELECT count(*) FROM v) - count(DISTINCT least))::BIGINT AS edges FROM (SELECT bound, node, min(root) AS least FROM tr GROUP BY ALL) GROUP BY bound")
def density_tree(spark, d):
    """How many edges of the spanning tree of mutual reachability are at most as heavy as three bounds, which is rows less the components that such edges make."""
    tree = density.spanning_tree(vectors(spark, d), 4)
    return tree.select(F.explode(F.array(F.lit(1.12), F.lit(1.15), F.lit(1.18))).alias("bound"), "w").groupBy("bound").agg(F.sum((F.col("w") <= F.col("bound")).cast("long")).alias("edges"))


@query(
    "sweep",
    f"WITH {G}, so AS (SELECT id, row_number() OVER (ORDER BY vec[1] DESC, id) AS size FROM v), sw AS (SELECT src AS id, sum(weight) AS w FROM net GROUP BY src), si AS (SELECT greatest(a.size, b.size) AS size, sum(weight) AS inside FROM net JOIN so a ON a.id = src JOIN so b ON b.id = dst GROUP BY ALL), "
    "sr AS (SELECT size, so.id, sum(coalesce(w, 0)) OVER k AS vol, sum(coalesce(inside, 0)) OVER k AS inside FROM so LEFT JOIN sw USING (id) LEFT JOIN si USING (size) WINDOW k AS (ORDER BY size ROWS UNBOUNDED PRECEDING)) "
    f"SELECT size, id, {R('(vol - inside) / least(vol, (SELECT sum(weight) FROM net) - vol)', 'conductance')} FROM sr WHERE size >= 5 AND size < (SELECT count(*) FROM v)",
)
def sweep(spark, d):
    """Sets of the vectors with the largest first components; the set of all has no cut."""
    g, nodes = net(spark, d)
    scores = vectors(spark, d).select("id", F.col("vec")[0].alias("score"))
    return r6(graph.sweep(g, scores, 5).where(F.col("size") < nodes.count()), "conductance")
