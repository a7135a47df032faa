"""Normalising, scaling, multiplying and aggregating coordinate matrices.

A sparse matrix is a table (row_id, col_id, value) without zeros; dense vectors are (id, dim, value);
a graph is (src, dst, weight), row `src` and column `dst`. A missing entry is zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matloom.plans.prefix import running


def ratio(a, b) -> Column:
    """a / b, and 0 where that is not a number."""
    return F.coalesce(F.nanvl(F.try_divide(a, b), F.lit(0.0)), F.lit(0.0))


def normalize(m: DataFrame, by: str = "col_id", p: int = 1, value: str = "value") -> DataFrame:
    """Entries over the p-norm (1 or 2; 0: unchanged) of their column or row; a zero norm counts as 1."""
    if p == 0:
        return m
    if p not in (1, 2):
        raise ValueError("p is 0, 1 or 2")
    size = F.sum(F.abs(value)) if p == 1 else F.sqrt(F.sum(F.col(value) * F.col(value)))
    # Sums are partial before they are shuffled, so that a common column is spread; the join is one that Spark can broadcast or split by measured sizes.
    sizes = m.groupBy(by).agg(size.alias("_size"))
    over = F.col(value) / F.when(F.col("_size") == 0, 1.0).otherwise(F.col("_size"))
    return m.join(sizes, by).select(*[over.alias(c) if c == value else c for c in m.columns])


def scale(m: DataFrame, v: DataFrame, by: str = "col_id") -> DataFrame:
    """Columns or rows times the vector v (id, value); those that v has no value for are left out, as times zero."""
    return m.join(v.select(F.col("id").alias(by), F.col("value").alias("_v")), by).withColumn("value", F.col("value") * F.col("_v")).drop("_v")


def normalize_graph(g: DataFrame, nodes: DataFrame, method: int = 1) -> DataFrame:
    """0: columns, 1: rows sum to one in absolute value, and empty ones get a self-loop; 2: over the root of row sum times column sum (signed; zero counts as 1)."""
    if method in (0, 1):
        by = "dst" if method == 0 else "src"
        some = normalize(g, by, 1, "weight").select("src", "dst", "weight")
        empty = nodes.join(g.groupBy(by).agg(F.sum(F.abs("weight")).alias("s")).where("s > 0").select(F.col(by).alias("id")), "id", "left_anti")
        return some.where("weight <> 0").unionByName(empty.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight")))
    if method != 2:
        raise ValueError("method is 0, 1 or 2")
    one = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    rows, cols = g.groupBy("src").agg(F.sum("weight").alias("r")), g.groupBy("dst").agg(F.sum("weight").alias("c"))
    return g.join(rows, "src").join(cols, "dst").select("src", "dst", (F.col("weight") / F.sqrt(one("r") * one("c"))).alias("weight"))


def zscore(x: DataFrame, by: str = "dim") -> DataFrame:
    """(x - mean) / sample deviation within each group; 0 where that is not a number."""
    stats = x.groupBy(by).agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_sd"))
    z = ratio(F.col("value") - F.col("_mean"), F.col("_sd"))
    return x.join(stats, by).select(*[z.alias(c) if c == "value" else c for c in x.columns])


def medians(x: DataFrame, by: str, value: str) -> DataFrame:
    """by, median: distinct values are counted, then placed by running sums over range partitions, so that no task holds a group's values."""
    placed = running(x.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), [by, "_v"], {"_n": "_before"})
    spans = placed.groupBy(by).agg(F.min("_before").alias("_start"), F.sum("_n").alias("_all"))
    first = F.col("_before") - F.col("_start")
    middle = placed.join(spans, by).where((first <= F.floor(F.col("_all") / 2)) & (first + F.col("_n") > F.floor((F.col("_all") - 1) / 2)))
    return middle.groupBy(by).agg(((F.min("_v") + F.max("_v")) / 2).alias("median"))


def robust_zscore(x: DataFrame, by: str = "dim") -> DataFrame:
    """(x - median) / median absolute deviation, unscaled; a zero deviation gives 0 at the median and an infinity elsewhere."""
    off = x.join(medians(x, by, "value").withColumnRenamed("median", "_m"), by).withColumn("_d", F.col("value") - F.col("_m"))
    mad = medians(off.withColumn("_abs", F.abs("_d")), by, "_abs").withColumnRenamed("median", "_mad")
    z = F.when(F.col("_mad") != 0, F.try_divide("_d", "_mad")).when(F.col("_d") == 0, 0.0).otherwise(F.signum("_d") * F.lit(float("inf")))
    return off.join(mad, by).select(*[z.alias(c) if c == "value" else c for c in x.columns])


def mean_center(x: DataFrame, by: str = "dim") -> DataFrame:
    means = x.groupBy(by).agg(F.avg("value").alias("_mean"))
    return x.join(means, by).select(*[(F.col("value") - F.col("_mean")).alias(c) if c == "value" else c for c in x.columns])


def normalize_scores(x: DataFrame, method: int = 1, by: str = "dim") -> DataFrame:
    """0: unchanged, 1: z-scores, 3: robust ones, 4: centred. 2 (rank-based) does not exist."""
    if method == 2:
        raise NotImplementedError("rank-based inverse normal scores")
    if method not in (0, 1, 3, 4):
        raise ValueError("the method is 0, 1, 3 or 4")
    return {0: lambda: x, 1: lambda: zscore(x, by), 3: lambda: robust_zscore(x, by), 4: lambda: mean_center(x, by)}[method]()


def one_hot(labels: DataFrame) -> DataFrame:
    """(row_id, col_id, 1) for labels that are not null or negative; columns in the order of labels. The distinct labels are ranked as a small table."""
    kept = labels.where(F.col("label") >= 0)
    cols = kept.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("col_id"))
    return kept.join(cols, "label").select(F.col("id").alias("row_id"), "col_id", F.lit(1.0).alias("value"))


def rank(x: DataFrame, ties: str = "average", off_by_one: bool = False) -> DataFrame:
    """id, rank from 1: ties get their average, or with "max" the largest rank (`off_by_one`: one less for ties). Distinct values are counted first, so a common value is one row."""
    counts = running(x.groupBy("value").agg(F.count(F.lit(1)).alias("n")), ["value"], {"n": "before"})
    n, before = F.col("n"), F.col("before")
    top = before + n - (F.when(n > 1, 1).otherwise(0) if off_by_one else F.lit(0))
    r = before + (n + 1) / 2 if ties == "average" else top.cast("double")
    return x.join(counts, "value").select("id", r.alias("rank"))


def times_vector(a: DataFrame, x: DataFrame, transpose: bool = False) -> DataFrame:
    """id, value of A x (or of its transpose times x)."""
    out, on = ("col_id", "row_id") if transpose else ("row_id", "col_id")
    return a.join(x.select(F.col("id").alias(on), F.col("value").alias("_x")), on).groupBy(F.col(out).alias("id")).agg(F.sum(F.col("value") * F.col("_x")).alias("value"))


def times_dense(a: DataFrame, b: DataFrame, transpose: bool = False) -> DataFrame:
    """id, dim, value of A B for dense B (id, dim, value)."""
    out, on = ("col_id", "row_id") if transpose else ("row_id", "col_id")
    return a.join(b.select(F.col("id").alias(on), "dim", F.col("value").alias("_x")), on).groupBy(F.col(out).alias("id"), "dim").agg(F.sum(F.col("value") * F.col("_x")).alias("value"))


def times_sparse(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B for sparse matrices."""
    right = b.select(F.col("row_id").alias("_k"), F.col("col_id").alias("_j"), F.col("value").alias("_x"))
    return a.join(right, a["col_id"] == right["_k"]).groupBy("row_id", F.col("_j").alias("col_id")).agg(F.sum(F.col("value") * F.col("_x")).alias("value"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "value")


def symmetric(g: DataFrame, mutual: bool = True) -> DataFrame:
    """Mutual: the root of w_ij w_ji; else the mean of both, a missing one being 0. No self-loops."""
    back = g.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("_w"))
    g = g.where("src <> dst")
    if mutual:
        return g.join(back, ["src", "dst"]).select("src", "dst", F.sqrt(F.col("weight") * F.col("_w")).alias("weight"))
    both = g.select("src", "dst", "weight").union(back.where("src <> dst"))
    return both.groupBy("src", "dst").agg((F.sum("weight") / 2).alias("weight"))


def grouped(m: DataFrame, groups: DataFrame, rows: DataFrame, what: str = "sum") -> DataFrame:
    """row_id, grp, value: sum, mean or variance of a row's entries over each group (id, grp) of columns.

    Missing entries are zeros, and count. Group sizes are few and go to the plan as constants, so that rows are
    spread over the groups without a join. A variance is made in one pass, of partial counts, means and squares about them, to which the missing
    entries are added as one more part; over n - 1, and 0 for one member.
    """
    sizes = sorted((r[0], r[1]) for r in groups.groupBy("grp").count().collect())
    every = F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(n).alias("n")) for g, n in sizes])).alias("g")
    placed = m.join(groups.select(F.col("id").alias("col_id"), "grp"), "col_id")
    sums = placed.groupBy("row_id", "grp").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("k"), F.var_pop("value").alias("v"))
    grid = rows.select(F.col("id").alias("row_id"), every).select("row_id", "g.grp", "g.n")
    full = grid.join(sums, ["row_id", "grp"], "left")
    n, k, s = F.col("n"), F.coalesce(F.col("k"), F.lit(0)), F.coalesce(F.col("s"), F.lit(0.0))
    if what == "mean":
        s = s / F.greatest(F.lit(1), n)
    elif what == "var":
        mean = F.coalesce(F.try_divide(s, k), F.lit(0.0))
        s = (k * F.coalesce("v", F.lit(0.0)) + mean * mean * k * (n - k) / F.greatest(F.lit(1), n)) / F.greatest(F.lit(1), n - 1)
    return full.select("row_id", "grp", s.alias("value"))


def tf_idf(m: DataFrame, n: int, size: float = 1e4) -> DataFrame:
    """Entries as ln(1 + size x / column sum) ln(1 + n / row sum), n being the number of columns: the weighting before a latent semantic index."""
    cols, rows = m.groupBy("col_id").agg(F.sum("value").alias("_c")), m.groupBy("row_id").agg(F.sum("value").alias("_r"))
    value = F.log1p(F.col("value") * F.lit(float(size)) / F.col("_c")) * F.log1p(F.lit(float(n)) / F.col("_r"))
    return m.join(cols, "col_id").join(rows, "row_id").select("row_id", "col_id", value.alias("value"))


def aligned(m: DataFrame, groups: DataFrame) -> DataFrame:
    """Columns scaled to their group's mean profile (groups: id, grp), the profiles having been scaled to the mean of all profiles: each by the least-squares factor. Missing entries count as zeros."""
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    own = groups.select(F.col("id").alias("col_id"), "grp")
    profile = m.join(own, "col_id").groupBy("row_id", "grp").agg(F.sum("value").alias("s")).join(sizes, "grp").select("row_id", "grp", (F.col("s") / F.col("n")).alias("p"))
    middle = profile.groupBy("row_id").agg((F.sum("p") / sizes.count()).alias("mid"))
    factor = profile.join(middle, "row_id").groupBy("grp").agg(ratio(F.sum(F.col("mid") * F.col("p")), F.sum(F.col("p") * F.col("p"))).alias("f"))
    target = profile.join(factor, "grp").select("row_id", "grp", (F.col("p") * F.col("f")).alias("y"))
    scales = m.join(own, "col_id").join(target, ["row_id", "grp"]).groupBy("col_id").agg(ratio(F.sum(F.col("y") * F.col("value")), F.sum(F.col("value") * F.col("value"))).alias("_f"))
    return m.join(scales, "col_id").select("row_id", "col_id", (F.col("value") * F.col("_f")).alias("value"))
