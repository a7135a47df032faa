"""Queries of the coordinate-matrix operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from matloom import functions
from matloom.operators import coo
from matloom.operators.dense import correlations
from matloom.queries.base import S, X, E, V, brands, labels, long, part_ids, parts, query, r6, supplier_vector, vectors
from matloom.sources.tables import table

ROUND = "round({}, 6) + 0.0"


def _r(e: str, name: str = "value") -> str:
    return f"{ROUND.format(e)} AS {name}"


@query("norm_l1_cols", f"WITH {S} SELECT row_id, col_id, round(value / CASE WHEN n = 0 THEN 1 ELSE n END, 9) AS value FROM (SELECT *, sum(abs(value)) OVER (PARTITION BY col_id) AS n FROM s)")
def norm_l1_cols(spark, d):
    return coo.normalize(parts(spark, d), "col_id").withColumn("value", F.round("value", 9))


@query("norm_l1_rows", f"WITH {S} SELECT row_id, col_id, round(value / CASE WHEN n = 0 THEN 1 ELSE n END, 9) AS value FROM (SELECT *, sum(abs(value)) OVER (PARTITION BY row_id) AS n FROM s)")
def norm_l1_rows(spark, d):
    return coo.normalize(parts(spark, d), "row_id").withColumn("value", F.round("value", 9))


@query("norm_l2_dense", f"WITH {E} SELECT id, dim, {_r('value / CASE WHEN n = 0 THEN 1 ELSE n END')} FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY id)) AS n FROM e)")
def norm_l2_dense(spark, d):
    return r6(coo.normalize(long(vectors(spark, d)), "id", 2), "value")


@query("scale_cols", f"WITH {S} SELECT row_id, col_id, {_r('value * s_acctbal')} FROM s JOIN supplier ON s_suppkey = col_id")
def scale_cols(spark, d):
    return r6(coo.scale(parts(spark, d), supplier_vector(spark, d)).select("row_id", "col_id", "value"), "value")


@query("scale_rows", f"WITH {S} SELECT row_id, col_id, {_r('value * p_retailprice')} FROM s JOIN part ON p_partkey = row_id")
def scale_rows(spark, d):
    v = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("value"))
    return r6(coo.scale(parts(spark, d), v, "row_id").select("row_id", "col_id", "value"), "value")


Z = "CASE WHEN sd IS NULL OR sd = 0 THEN 0 ELSE (value - m) / sd END"


@query("zscore", f"WITH {E} SELECT id, dim, {_r(Z)} FROM (SELECT *, avg(value) OVER (PARTITION BY dim) AS m, stddev_samp(value) OVER (PARTITION BY dim) AS sd FROM e)")
def zscore(spark, d):
    return r6(coo.zscore(long(vectors(spark, d))), "value")


@query("zscore_rows", f"WITH {E} SELECT id, dim, {_r(Z)} FROM (SELECT *, avg(value) OVER (PARTITION BY id) AS m, stddev_samp(value) OVER (PARTITION BY id) AS sd FROM e)")
def zscore_rows(spark, d):
    return r6(coo.zscore(long(vectors(spark, d)), "id"), "value")


@query("robust_zscore", f"WITH {E}, m AS (SELECT dim, median(value) AS m FROM e GROUP BY dim), a AS (SELECT dim, median(abs(value - m)) AS mad FROM e JOIN m USING (dim) GROUP BY dim) SELECT id, dim, {_r('(value - m) / nullif(mad, 0)')} FROM e JOIN m USING (dim) JOIN a USING (dim)")
def robust_zscore(spark, d):
    return r6(coo.robust_zscore(long(vectors(spark, d))).select("id", "dim", "value"), "value")


@query("mean_center", f"WITH {E} SELECT id, dim, {_r('value - avg(value) OVER (PARTITION BY dim)')} FROM e")
def mean_center(spark, d):
    return r6(coo.mean_center(long(vectors(spark, d))), "value")


@query("one_hot", f"WITH {V} SELECT id AS row_id, (dense_rank() OVER (ORDER BY label) - 1)::BIGINT AS col_id, 1.0::DOUBLE AS value FROM v WHERE label >= 0")
def one_hot(spark, d):
    return coo.one_hot(labels(spark, d))


def _sizes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("value"))


@query("rank_avg", "SELECT p_partkey AS id, (rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0)::DOUBLE AS rank FROM part")
def rank_avg(spark, d):
    return coo.rank(_sizes(spark, d))


@query("rank_max", "SELECT p_partkey AS id, (rank() OVER (ORDER BY p_size) + count(*) OVER (PARTITION BY p_size) - 1)::DOUBLE AS rank FROM part")
def rank_max(spark, d):
    return coo.rank(_sizes(spark, d), "max")


@query("rank_max_compat", "SELECT p_partkey AS id, (rank() OVER (ORDER BY p_size) + count(*) OVER (PARTITION BY p_size) - 1 - CASE WHEN count(*) OVER (PARTITION BY p_size) > 1 THEN 1 ELSE 0 END)::DOUBLE AS rank FROM part")
def rank_max_compat(spark, d):
    return coo.rank(_sizes(spark, d), "max", off_by_one=True)


@query("spmv", f"WITH {S} SELECT row_id AS id, {_r('sum(value * s_acctbal)')} FROM s JOIN supplier ON s_suppkey = col_id GROUP BY row_id")
def spmv(spark, d):
    return r6(coo.times_vector(parts(spark, d), supplier_vector(spark, d)), "value")


def _supplier_matrix(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.posexplode(F.array("s_acctbal", F.col("s_nationkey").cast("double"))).alias("dim", "value"))


@query("spmm", f"WITH {S}, b AS (SELECT s_suppkey AS id, 0 AS dim, s_acctbal AS x FROM supplier UNION ALL SELECT s_suppkey, 1, s_nationkey::DOUBLE FROM supplier) SELECT row_id AS id, dim, {_r('sum(value * x)')} FROM s JOIN b ON id = col_id GROUP BY ALL")
def spmm(spark, d):
    return r6(coo.times_dense(parts(spark, d), _supplier_matrix(spark, d)), "value")


@query("spmm_t", f"WITH {S}, b AS (SELECT p_partkey AS id, 0 AS dim, p_retailprice AS x FROM part UNION ALL SELECT p_partkey, 1, p_size::DOUBLE FROM part) SELECT col_id AS id, dim, {_r('sum(value * x)')} FROM s JOIN b ON id = row_id GROUP BY ALL")
def spmm_t(spark, d):
    b = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.posexplode(F.array("p_retailprice", F.col("p_size").cast("double"))).alias("dim", "value"))
    return r6(coo.times_dense(parts(spark, d), b, transpose=True), "value")


@query("spmv_t", f"WITH {S} SELECT col_id AS id, {_r('sum(value * p_retailprice)')} FROM s JOIN part ON p_partkey = row_id GROUP BY col_id")
def spmv_t(spark, d):
    v = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("value"))
    return r6(coo.times_vector(parts(spark, d), v, transpose=True), "value")


@query("spspmm", f"WITH {S}, {X} SELECT s.col_id AS row_id, x.col_id, {_r('sum(s.value * x.value)')} FROM s JOIN x USING (row_id) GROUP BY ALL")
def spspmm(spark, d):
    return r6(coo.times_sparse(coo.transposed(parts(spark, d)), brands(spark, d)), "value")


def _nations(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("grp"))


GRID = f"WITH {S}, g AS (SELECT s_suppkey AS col_id, s_nationkey::BIGINT AS grp FROM supplier), n AS (SELECT grp, count(*) AS n FROM g GROUP BY grp), a AS (SELECT row_id, grp, sum(value) AS t, count(*) AS k FROM s JOIN g USING (col_id) GROUP BY ALL), f AS (SELECT p_partkey AS row_id, n.grp, n, coalesce(t, 0) AS t, coalesce(k, 0) AS k FROM part CROSS JOIN n LEFT JOIN a ON a.row_id = p_partkey AND a.grp = n.grp)"
SPREAD = f"{GRID}, q AS (SELECT row_id, grp, sum((value - t / greatest(1, n)) ** 2) AS q FROM s JOIN g USING (col_id) JOIN f USING (row_id, grp) GROUP BY ALL) SELECT row_id, grp, {_r('(coalesce(q, 0) + (n - k) * (t / greatest(1, n)) ** 2) / greatest(1, n - 1)')} FROM f LEFT JOIN q USING (row_id, grp)"
DENSE = f"WITH {E}, l AS (SELECT id, label::BIGINT AS grp FROM v)"

for what, sql in (("sum", f"{GRID} SELECT row_id, grp, {_r('t')} FROM f"), ("mean", f"{GRID} SELECT row_id, grp, {_r('t / greatest(1, n)')} FROM f"), ("var", SPREAD)):
    query(f"group_{what}_sparse", sql)(lambda spark, d, what=what: r6(coo.grouped(parts(spark, d), _nations(spark, d), part_ids(spark, d), what), "value"))
for what, e in (("sum", "sum(value)"), ("mean", "avg(value)"), ("var", "coalesce(var_samp(value), 0)")):

    def dense_group(spark, d, what=what):
        m = long(vectors(spark, d)).select(F.col("dim").cast("long").alias("row_id"), F.col("id").alias("col_id"), "value")
        groups = labels(spark, d).select("id", F.col("label").cast("long").alias("grp"))
        return r6(coo.grouped(m, groups, m.select(F.col("row_id").alias("id")).distinct(), what), "value")

    query(f"group_{what}_dense", f"{DENSE} SELECT dim::BIGINT AS row_id, grp, {_r(e)} FROM e JOIN l USING (id) GROUP BY ALL")(dense_group)


@query("row_stats", f"WITH {S} SELECT row_id, {_r('sum(value)', 'total')}, {_r('sum(value) / (SELECT count(*) FROM supplier)', 'mean')}, {_r('CASE WHEN count(*) < (SELECT count(*) FROM supplier) THEN greatest(max(value), 0) ELSE max(value) END', 'top')}, count(*) AS nnz FROM s GROUP BY row_id")
def row_stats(spark, d):
    n = table(spark, d, "supplier").count()
    got = parts(spark, d).groupBy("row_id").agg(F.sum("value").alias("total"), (F.sum("value") / n).alias("mean"), F.when(F.count(F.lit(1)) < n, F.greatest(F.max("value"), F.lit(0.0))).otherwise(F.max("value")).alias("top"), F.count(F.lit(1)).alias("nnz"))
    return r6(got, "total", "mean", "top")


@query("row_corr", f"WITH {E} SELECT a.dim AS i, b.dim AS j, {_r('corr(a.value, b.value)', 'r')} FROM e a JOIN e b USING (id) GROUP BY ALL")
def row_corr(spark, d):
    """Correlations of all pairs of components, from one pass that sums products."""
    return r6(correlations(vectors(spark, d)), "r")


@query("tf_idf", f"WITH {S} SELECT row_id, col_id, {_r('ln(1 + value * 10000 / sum(value) OVER (PARTITION BY col_id)) * ln(1 + (SELECT count(*) FROM supplier) / sum(value) OVER (PARTITION BY row_id))')} FROM s")
def tf_idf(spark, d):
    return r6(coo.tf_idf(parts(spark, d), table(spark, d, "supplier").count()), "value")


@query(
    "aligned",
    f"WITH {S}, g AS (SELECT s_suppkey AS col_id, s_nationkey::BIGINT AS grp FROM supplier), n AS (SELECT grp, count(*) AS n FROM g GROUP BY grp), p AS (SELECT row_id, grp, sum(value) / any_value(n) AS p FROM s JOIN g USING (col_id) JOIN n USING (grp) GROUP BY ALL), m AS (SELECT row_id, sum(p) / (SELECT count(*) FROM n) AS mid FROM p GROUP BY row_id), "
    "f AS (SELECT grp, sum(mid * p) / sum(p * p) AS f FROM p JOIN m USING (row_id) GROUP BY grp), c AS (SELECT col_id, sum(p * f * value) / sum(value * value) AS k FROM s JOIN g USING (col_id) JOIN p USING (row_id, grp) JOIN f USING (grp) GROUP BY col_id) "
    f"SELECT row_id, col_id, {_r('value * k')} FROM s JOIN c USING (col_id)",
)
def aligned(spark, d):
    """Suppliers scaled to their nation's profile."""
    return r6(coo.aligned(parts(spark, d), _nations(spark, d)), "value")


@query("clamp_simplex", f"WITH {E}, c AS (SELECT id, dim, least(1, greatest(0, value)) AS value FROM e) SELECT id, dim, {_r('value / CASE WHEN sum(value) OVER (PARTITION BY id) = 0 THEN 1 ELSE sum(value) OVER (PARTITION BY id) END')} FROM c")
def clamp_simplex(spark, d):
    return r6(functions.clamp_to_simplex(long(vectors(spark, d))), "value")


@query("binarize", f"WITH {S} SELECT row_id, col_id, 1.0::DOUBLE AS value FROM s WHERE value <> 0")
def binarize(spark, d):
    return functions.binarize(parts(spark, d))


@query("normalize_scores", f"WITH {E} SELECT id, dim, {_r('value - avg(value) OVER (PARTITION BY dim)')} FROM e")
def normalize_scores(spark, d):
    """By its number: 4 is centring."""
    return r6(functions.normalize_scores(long(vectors(spark, d)), 4), "value")
