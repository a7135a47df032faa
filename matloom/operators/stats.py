"""Specificity, marker scores, set enrichment, autocorrelation and rank correlation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matloom.operators import coo
from matloom.operators.dense import rows_of
from matloom.operators.graph import arrays, column_groups, diffuse, each
from matloom.plans.materialize import cut
from matloom.plans.prefix import running


def _bound(over: Column, variance: Column, most: Column) -> Column:
    """over² / (2 (variance + most * over / 3)) where `over` is positive, else 0."""
    return F.when(over > 0, F.coalesce(F.try_divide(over * over, 2 * (variance + most * over / 3)), F.lit(0.0))).otherwise(0.0)


def specificity(s: DataFrame, h: DataFrame, n: int, m: int) -> DataFrame:
    """row_id, dim, profile, upper, lower (log10) of features x observations (n columns, m rows) against weights h (id, dim, value) of observations.

    A matrix with negative entries is first raised by its least one, entries that are present only.
    """
    low = s.agg(F.min("value")).first()[0]
    if low is not None and low < 0:
        s = s.withColumn("value", F.col("value") - F.lit(float(low)))
    mean = h.groupBy("dim").agg((F.sum("value") / n).alias("mu"))
    scaled = h.join(mean, "dim").select("id", "dim", F.when(F.col("mu") == 0, F.lit(0.0)).otherwise(F.try_divide("value", "mu")).alias("value"))
    rows = s.groupBy("row_id").agg(F.avg("value").alias("r"), (F.count(F.lit(1)) / n).alias("f"))
    q = s.groupBy(F.col("col_id").alias("id")).agg((F.count(F.lit(1)) / m).alias("q"))
    whole = q.agg((F.sum("q") / n).alias("mq"))
    gamma = scaled.join(q, "id").join(F.broadcast(whole), F.lit(True)).withColumn("g", F.col("value") * F.col("q") / F.col("mq"))
    sums = gamma.groupBy("dim").agg(F.sum("g").alias("g1"), F.sum(F.col("g") ** 2).alias("g2"), F.greatest(F.max("g"), F.lit(0.0)).alias("a"))
    obs = coo.times_dense(s, scaled).select(F.col("id").alias("row_id"), "dim", F.col("value").alias("o"))
    dims = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("dim", "g1", "g2", "a"), r)]) for r in sums.orderBy("dim").collect()])).alias("g")
    grid = rows.select("*", dims).select(*rows.columns, "g.*")  # a few columns beside each feature
    both = grid.join(obs, ["row_id", "dim"], "left").withColumn("o", F.coalesce("o", F.lit(0.0)))
    over = F.col("o") - F.col("f") * F.col("r") * F.col("g1")
    nu = F.col("f") * F.col("r") ** 2 * F.col("g2")
    upper = _bound(over, nu, F.col("r") * F.col("a"))
    lower = F.when(over < 0, F.coalesce(F.try_divide(over * over, 2 * nu), F.lit(0.0))).otherwise(0.0)
    return both.select("row_id", "dim", (F.col("o") / n).alias("profile"), (upper / math.log(10)).alias("upper"), (lower / math.log(10)).alias("lower"))


def label_weights(labels: DataFrame) -> DataFrame:
    """Labels from 1 as one-hot weights; 0 is ignored."""
    return labels.where("label > 0").select("id", F.col("label").cast("int").alias("dim"), F.lit(1.0).alias("value"))


def signature(s: DataFrame, x: DataFrame, ids: DataFrame, m: int) -> DataFrame:
    """id, dim, value: z-scores of marker sums of each observation, adjusted for its depth: s is features (m) x observations (ids), x features x sets."""
    stat = coo.times_sparse(coo.transposed(s), x).select(F.col("row_id").alias("id"), F.col("col_id").alias("dim"), F.col("value").alias("stat"))
    depth = s.groupBy(F.col("col_id").alias("id")).agg((F.sum("value") / m).alias("mu"), F.count(F.lit(1)).alias("k"))
    spread = s.join(depth.withColumnRenamed("id", "col_id"), "col_id").groupBy(F.col("col_id").alias("id")).agg(F.max("mu").alias("mu"), ((F.sum((F.col("value") - F.col("mu")) ** 2) + (m - F.max("k")) * F.max("mu") ** 2) / max(1, m - 1)).alias("var"))
    sets = sorted((r[0], r[1], r[2]) for r in x.groupBy("col_id").agg(F.sum("value"), F.sum(F.col("value") ** 2)).collect())
    every = F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.lit(a).alias("x1"), F.lit(b).alias("x2")) for c, a, b in sets])).alias("g")
    grid = ids.join(spread, "id", "left").select("id", "mu", "var", every).select("id", "mu", "var", "g.*")
    z = F.try_divide(F.coalesce("stat", F.lit(0.0)) - F.col("mu") * F.col("x1"), F.sqrt(F.col("var") * F.col("x2")))
    return grid.join(stat, ["id", "dim"], "left").select("id", "dim", F.coalesce(F.nanvl(z, F.lit(0.0)), F.lit(0.0)).alias("value"))


def marker_scores(g: DataFrame, nodes: DataFrame, s: DataFrame, x: DataFrame, alpha: float = 0.85, rounds: int = 5, method: int = 2, ignore_baseline: bool = False) -> DataFrame:
    """id, set, value: diffused expression of a set's markers as log-ratios to the diffusion of a constant, weighted."""
    flat = nodes.select("id", F.lit(0).alias("dim"), F.lit(1.0).alias("value"))
    plain = diffuse(g, nodes, flat, alpha, rounds, 0).select("id", F.col("value").alias("pr"))
    used = x.select(F.col("row_id").alias("dim")).distinct()
    own = s.join(used.withColumnRenamed("dim", "row_id"), "row_id").select(F.col("col_id").alias("id"), F.col("row_id").alias("dim"), "value")
    spread = diffuse(g, nodes, own, alpha, rounds, method)
    base = own.groupBy("dim").agg(F.sum("value").alias("b"))
    w = x.select(F.col("row_id").alias("dim"), F.col("col_id").alias("set"), "value").join(base, "dim")
    per = Window.partitionBy("set")
    w = w.withColumn("w", F.col("value") if ignore_baseline else F.col("value") * F.col("b") / F.sum("b").over(per))
    w = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") ** 2).over(per))).select("dim", "set", "w")
    ratio = F.when((F.col("value") > 0) & (F.col("pr") > 0), F.col("value") * F.log2(F.col("value") / F.col("pr"))).otherwise(0.0)
    return spread.join(plain, "id").join(w, "dim").groupBy("id", "set").agg(F.sum(F.col("w") * ratio).alias("value"))


def set_enrichment(scores: DataFrame, sets: DataFrame) -> DataFrame:
    """set, logp, threshold for scores (id, score) and memberships (row_id, col_id): the largest bound along the ranking from the top, and the rank (from 0) where it stands."""
    return set_enrichments(scores.select("id", F.lit(0).alias("dim"), F.col("score").alias("value")), sets).drop("dim")


def set_enrichments(scores: DataFrame, sets: DataFrame) -> DataFrame:
    """dim, set, logp, threshold: the same for every column of a matrix of scores (id, dim, value); all columns are ranked together, over range partitions."""
    keyed = scores.select("dim", "id", F.col("value").alias("score"), (-F.col("value")).alias("neg"), F.lit(1).alias("one"), (F.col("value") ** 2).alias("sq"))
    ranked = running(keyed, ["dim", "neg", "id"], {"one": "r", "score": "a", "sq": "q"})
    start = ranked.groupBy("dim").agg(F.min("r").alias("r0"), F.min(F.struct("r", "a", "q")).alias("first"), F.count(F.lit(1)).alias("m"), F.max("score").alias("top"))
    hits = ranked.join(sets.where("value <> 0").select(F.col("row_id").alias("id"), F.col("col_id").alias("set")).distinct(), "id").join(start, "dim")
    hits = hits.select("dim", "set", "score", "sq", (F.col("r") - F.col("r0")).alias("r"), (F.col("a") - F.col("first.a")).alias("a"), (F.col("q") - F.col("first.q")).alias("q"), "m", "top")
    hits = running(hits, ["dim", "set", "r"], {"score": "o"})
    size = hits.groupBy("dim", "set").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r", "o")).alias("own"))
    hits = hits.join(size, ["dim", "set"]).withColumn("o", F.col("o") - F.col("own.o") + F.col("score")).withColumn("p", F.col("n") / F.col("m"))
    over = F.col("o") - (F.col("a") + F.col("score")) * F.col("p")
    best = hits.withColumn("l", _bound(over, (F.col("q") + F.col("sq")) * F.col("p"), F.col("top")))
    best = best.groupBy("dim", "set").agg(F.max("n").alias("n"), F.max(F.struct("l", (-F.col("r")).alias("r"))).alias("b"))
    return best.select("dim", "set", F.when(F.col("n") > 1, F.col("b.l")).otherwise(0.0).alias("logp"), F.when(F.col("n") > 1, -F.col("b.r")).otherwise(0).cast("long").alias("threshold"))


def _products(g: DataFrame, x: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gx: xᵀGx of every column; keys besides it are carried along. A node's columns go over the edges as one array, and sums are partial before they are shuffled."""
    extra = [k for k in keys if k != "dim"]
    out = None
    for dims in column_groups(x):
        own = cut(arrays(x, dims, ["id", *extra]), "columns")
        far = own.select(F.col("id").alias("dst"), *extra, F.col("vec").alias("x"))
        y = g.join(far, "dst").groupBy(F.col("src").alias("id"), *extra).agg(each(lambda d: F.sum(F.col("weight") * F.col("x")[d]), len(dims)).alias("y"))
        sums = y.join(own, ["id", *extra]).groupBy(*extra).agg(each(lambda d: F.sum(F.col("y")[d] * F.col("vec")[d]), len(dims)).alias("s"))
        got = sums.select(*extra, F.explode(F.arrays_zip(F.array(*map(F.lit, dims)).alias("dim"), F.col("s").alias("gx"))).alias("e"))
        got = got.select(*extra, F.col("e.dim").cast(x.schema["dim"].dataType).alias("dim"), F.col("e.gx").alias("gx"))
        out = got if out is None else out.union(got)
    return x.limit(0).select(*extra, "dim", F.col("value").alias("gx")) if out is None else out


def _sums(x: DataFrame) -> DataFrame:
    return x.groupBy("dim").agg(F.sum(F.col("value") ** 2).alias("x2"), F.sum(F.col("value") ** 4).alias("x4"))


def moran(g: DataFrame, x: DataFrame, n: int, method: int = 1) -> DataFrame:
    """dim, stat: n xᵀGx / (W Σx²), of normalised scores; null for a constant."""
    x = cut(coo.normalize_scores(x, method), "scores")
    w = g.agg(F.sum("weight").alias("w"))
    return _products(g, x, ["dim"]).join(_sums(x), "dim").join(F.broadcast(w), F.lit(True)).select("dim", F.try_divide(n * F.col("gx"), F.col("w") * F.col("x2")).alias("stat"))


def moran_parametric(g: DataFrame, x: DataFrame, n: int, method: int = 4) -> DataFrame:
    """dim, stat, z, mu, sigma, by the moments of a random assignment; with fewer than four nodes these have no variance: z and sigma are null."""
    x = cut(coo.normalize_scores(x, method), "scores")
    w = g.agg(F.sum("weight")).first()[0] or 0.0
    both = g.select("src", "dst", "weight").union(g.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    s1 = 0.5 * (both.agg(F.sum(F.col("w") ** 2)).first()[0] or 0.0)
    s2 = both.groupBy("src").agg(F.sum("w").alias("t")).agg(F.sum(F.col("t") ** 2)).first()[0] or 0.0
    s4 = (n * (n - 3) + 3) * s1 - n * s2 + 3 * w * w
    s5 = n * (n - 1) * s1 - 2 * n * s2 + 6 * w * w
    below = (n - 1) * (n - 2) * (n - 3) * w * w
    mu = -1.0 / max(1, n - 1)
    sums = _products(g, x, ["dim"]).join(_sums(x), "dim")
    stat = F.try_divide(n * F.col("gx"), F.lit(w) * F.col("x2"))
    s3 = F.try_divide(F.col("x4") / n, (F.col("x2") / n) ** 2)
    sigma = F.sqrt(F.lit(n * s4 / below) - F.lit(s5 / below) * s3 - F.lit(mu * mu)) if below else F.lit(None).cast("double")
    return sums.select("dim", stat.alias("stat"), F.try_divide(stat - mu, sigma).alias("z"), F.lit(mu).alias("mu"), sigma.alias("sigma"))


def geary(g: DataFrame, x: DataFrame, n: int, method: int = 1) -> DataFrame:
    """dim, stat: (n - 1) xᵀ(D - G)x / (2 W Σx²) with column sums D; classic: twice that."""
    x = cut(coo.normalize_scores(x, method), "scores")
    w = g.agg(F.sum("weight").alias("w"))
    stat = F.try_divide((n - 1) * (F.col("dx") - F.col("gx")), 2 * F.col("w") * F.col("x2"))
    return _products(g, x, ["dim"]).join(_degrees(g, x, ["dim"]), "dim").join(_sums(x), "dim").join(F.broadcast(w), F.lit(True)).select("dim", stat.alias("stat"), (2 * stat).alias("classic"))


def _degrees(g: DataFrame, x: DataFrame, keys: list[str]) -> DataFrame:
    return g.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("d")).join(x, "id").groupBy(*keys).agg(F.sum(F.col("d") * F.col("value") ** 2).alias("dx"))


#: Nodes and edges of a block that one task holds in moved_products(), and edges multiplied at once.
NODES, EDGES, AT_ONCE = 16_384, 8_000_000, 16_384


def _block_sums(rows: DataFrame, width: int, turns: int) -> DataFrame:
    """turn, pos, gx, dx, met of each block (block, side, a, b, weight, own, vec): side 0 has its edges, side 1 the vectors of their first ends in any turn, side 2 those of all nodes. A node's values go to `own`, one for each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        gx, dx, met = np.zeros((turns, width)), np.zeros((turns, width)), np.zeros(turns, np.int64)
        ids = ends = near = first = weights = whole = known = x = None

        def begin() -> None:
            nonlocal ids, ends, near, first, weights, whole, known, x
            src, dst, w = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            order = np.argsort(dst, kind="stable")
            ids, near = np.unique(src[order], return_inverse=True)
            near, weights = near.astype(np.int32), w[order]
            ends, first = np.unique(dst[order], return_index=True)
            whole, first = np.add.reduceat(weights, first), np.append(first, len(order))
            known, x = np.zeros(len(ids), bool), np.zeros((turns, len(ids), width))

        def places(names: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rows whose node is among the names, and where."""
            pos = np.minimum(np.searchsorted(names, own), len(names) - 1)
            rows = np.flatnonzero(names[pos] == own)
            return rows, pos[rows]

        def multiply(own: np.ndarray, vec: np.ndarray) -> None:
            for t in range(turns):
                rows, pos = places(ends, own[:, t])
                if not len(rows):
                    continue
                dx[t] += whole[pos] @ (vec[rows] ** 2)
                long = first[pos + 1] - first[pos]
                group = np.cumsum(long) // AT_ONCE
                cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(rows)]
                for i, j in zip(cuts, cuts[1:]):
                    some, before = long[i:j], np.cumsum(long[i:j]) - long[i:j]
                    e = np.repeat(first[pos[i:j]] - before, some) + np.arange(some.sum())
                    far = near[e]
                    met[t] += int(known[far].sum())
                    y = x[t][far]
                    y *= weights[e][:, None]
                    gx[t] += (np.add.reduceat(y, before) * vec[rows[i:j]]).sum(0)

        for batch in batches:
            if not batch.num_rows:
                continue
            block, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                if block[a] != at:
                    at, ids = block[a], None
                    held.clear()
                part = batch.slice(a, b - a)
                if side[a] == 0:
                    held.append(tuple(part.column(i).to_numpy() for i in (2, 3, 4)))
                    continue
                if held:
                    begin()
                if ids is None:
                    continue
                own, vec = rows_of(part.column(5), np.int64), rows_of(part.column(6))
                if side[a] == 1:
                    for t in range(turns):
                        rows, pos = places(ids, own[:, t])
                        x[t, pos] = vec[rows]
                        known[pos] = True
                else:
                    multiply(own, vec)
        turn, pos = np.divmod(np.arange(turns * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(turn, pa.int32()), pa.array(pos, pa.int32()), pa.array(gx.ravel()), pa.array(dx.ravel()), pa.array(np.repeat(met, width))], names=["turn", "pos", "gx", "dx", "met"])

    return rows.select("block", "side", "a", "b", "weight", "own", "vec").mapInArrow(run, "turn int, pos int, gx double, dx double, met long")


def moved_products(g: DataFrame, x: DataFrame, moved: DataFrame, rounds: int) -> DataFrame:
    """perm, dim, gx, dx: xᵀGx and xᵀDx, with column sums D, of every column where nothing has moved (perm 0) and in each round of `moved` (own, perm, id), in which the node `own` has the values of `id`.

    No permuted values are written as rows. Edges are dealt by their first ends into blocks of a bounded size; a block holds its edges and its own nodes' values in all rounds, and all nodes stream past it once, each with the nodes that it stands for.
    """
    g = g.where("src IS NOT NULL AND dst IS NOT NULL AND weight IS NOT NULL")
    owns = moved.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("perm", "own"))), lambda m: m["own"]).alias("own"))
    owns = cut(owns.select("id", F.concat(F.array("id"), "own").alias("own")), "owns")
    n, size = owns.count(), g.count()
    blocks = max(1, math.ceil(n / NODES), math.ceil(size / EDGES), min(2 * g.sparkSession.sparkContext.defaultParallelism, n // 512))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    links = g.select(block(F.col("src").cast("long")).alias("block"), F.lit(0).alias("side"), F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.col("weight").cast("double").alias("weight"), none("array<long>").alias("own"), none("array<double>").alias("vec"))
    out = None
    for dims in column_groups(x):
        nodes = owns.join(arrays(x, dims, ["id"]), "id").select(F.transform("own", lambda c: c.cast("long")).alias("own"), "vec")
        send = lambda side, to: nodes.select(F.explode(to).alias("block"), F.lit(side).alias("side"), none("long").alias("a"), none("long").alias("b"), none("double").alias("weight"), "own", "vec")  # noqa: B023, E731
        sent = send(1, F.array_distinct(F.transform("own", block))).union(send(2, F.sequence(F.lit(0), F.lit(blocks - 1))))
        rows = links.union(sent).repartition(blocks, "block").sortWithinPartitions("block", "side")
        sums = _block_sums(rows, len(dims), rounds + 1).groupBy("turn", "pos").agg(F.sum("gx").alias("gx"), F.sum("dx").alias("dx"), F.sum("met").alias("met")).where("met > 0")
        got = sums.select(F.col("turn").alias("perm"), F.array(*map(F.lit, dims))[F.col("pos")].cast(x.schema["dim"].dataType).alias("dim"), "gx", "dx")
        out = got if out is None else out.union(got)
    return x.limit(0).select(F.lit(0).alias("perm"), "dim", F.col("value").alias("gx"), F.col("value").alias("dx")) if out is None else cut(out, "products")


def permuted(g: DataFrame, x: DataFrame, n: int, what: str = "moran", rounds: int = 30, seed: int = 0, method: int = 1) -> DataFrame:
    """dim, stat, z, mu, sigma, where the moments are of the unscaled statistic under `rounds` permutations of the nodes, which follow from hashes of the seed, the round and the id."""
    x = cut(coo.normalize_scores(x, method), "scores")
    ids = cut(x.select("id").distinct(), "ids")
    place = running(ids.withColumn("one", F.lit(1)), ["id"], {"one": "place"}).select("id", "place")
    drawn = ids.select("id", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("perm"))
    # Ranks of the hashes of all rounds at once, over range partitions; round r's places follow those of r - 1.
    drawn = drawn.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), "perm", "id"))).withColumn("one", F.lit(1))
    drawn = running(drawn, ["perm", "h", "id"], {"one": "place"}).withColumn("place", F.col("place") - (F.col("perm") - 1) * ids.count())
    moved = drawn.select(F.col("id").alias("own"), "perm", "place").join(place, "place").select("own", "perm", F.col("id"))
    sums = moved_products(g, x, moved, rounds)
    if what == "geary":
        sums = sums.withColumn("gx", F.col("dx") - F.col("gx"))
    moments = sums.where("perm > 0").groupBy("dim").agg(F.avg("gx").alias("mu"), F.stddev_samp("gx").alias("sigma"))
    real = sums.where("perm = 0").select("dim", "gx")
    w = g.agg(F.sum("weight").alias("w"))
    sign = -1 if what == "geary" else 1
    factor = F.try_divide(F.lit(float(n - 1 if what == "geary" else n)), (2 if what == "geary" else 1) * F.col("w") * F.col("x2"))
    got = real.join(moments, "dim").join(_sums(x), "dim").join(F.broadcast(w), F.lit(True))
    z = F.coalesce(F.try_divide(F.col("gx") - F.col("mu"), F.col("sigma")), F.lit(0.0)) * sign
    return got.select("dim", (F.col("gx") * factor).alias("stat"), z.alias("z"), "mu", "sigma")


def _ranks(y: DataFrame, n: int, compat: bool) -> DataFrame:
    """id, dim, f, g and k, cum: shares of values up to each one and from it on, and the place and running sum by f. Columns are ranked together over range partitions."""
    counts = running(y.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n")), ["dim", "value"], {"n": "before"})
    start = counts.groupBy("dim").agg(F.min("before").alias("start"))
    less = F.when(F.col("n") > 1, 1).otherwise(0) if compat else F.lit(0)
    counts = counts.join(start, "dim").select("dim", "value", ((F.col("before") - F.col("start") + F.col("n") - less) / n).alias("f"), ((n - F.col("before") + F.col("start") - less) / n).alias("g"))
    placed = running(y.join(counts, ["dim", "value"]).withColumn("one", F.lit(1)), ["dim", "f", "id"], {"one": "k", "f": "cum"})
    first = placed.groupBy("dim").agg(F.min(F.struct("k", "cum")).alias("first"))
    return placed.join(first, "dim").select("id", "dim", "f", "g", (F.col("k") - F.col("first.k") + (0 if compat else 1)).alias("k"), (F.col("cum") - F.col("first.cum") + F.col("f")).alias("cum"))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """i, steps: what the ranks of all columns move by from a row to the next (i, fs, nexts), summed for each i of a batch."""
    for batch in batches:
        if batch.num_rows:
            i, own = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            moved = np.abs(rows_of(batch.column(1)) - rows_of(batch.column(2)))
            sums = np.zeros((len(i), moved.shape[1]))
            np.add.at(sums, own, moved)
            yield pa.RecordBatch.from_arrays([pa.array(i, batch.column(0).type), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["i", "steps"])


def xicor_matrix(x: DataFrame, y: DataFrame, n: int, compat: bool = False) -> DataFrame:
    """i, j, xi, z of Chatterjee's rank correlation of every column of x with every column of y (id, dim, value; the same n ids), direction x to y. Ties in x go by id. `compat`: tied ranks one too small and the variance's index from 0.

    Every column is ranked once. A row then meets the one after it in an x column by id, with the ranks of all its y columns at once, and what they differ by is summed before it is shuffled.
    """
    ranked = cut(_ranks(y, n, compat), "ranks")
    b = 2 * n - 2 * F.col("k") + 1
    m = (F.col("cum") + (n - F.col("k")) * F.col("f")) / n
    own = ranked.groupBy(F.col("dim").alias("j")).agg(F.avg(F.col("g") * (1 - F.col("g"))).alias("cu"), (F.avg(b * F.col("f") ** 2) / n).alias("ai"), (F.avg(b * F.col("f")) / n).alias("ci"), F.avg(m * m).alias("bb"))
    place = running(x.withColumn("one", F.lit(1)), ["dim", "value", "id"], {"one": "place"}).select(F.col("dim").alias("i"), "id", "place")
    after = place.join(place.select("i", F.col("id").alias("next"), (F.col("place") - 1).alias("place")), ["i", "place"]).select("i", "id", "next")
    dims = ranked.select("dim").distinct().select(F.col("dim").alias("j"), (F.row_number().over(Window.orderBy("dim")) - 1).alias("pos"))  # a row for each column
    wide = ranked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "f"))), lambda x: x["f"]).alias("fs"))
    steps = after.join(wide, "id").join(wide.select(F.col("id").alias("next"), F.col("fs").alias("nexts")), "next").select("i", "fs", "nexts")
    kind = x.schema["dim"].dataType.simpleString()
    steps = steps.mapInArrow(_steps, f"i {kind}, steps array<double>").select("i", F.posexplode("steps").alias("pos", "step"))
    steps = steps.groupBy("i", "pos").agg((F.sum("step") / (2 * n)).alias("a1")).join(dims, "pos")
    xi = 1 - F.try_divide("a1", "cu")
    v = F.try_divide(F.col("ai") - 2 * F.col("bb") + F.col("ci") ** 2, F.col("cu") ** 2)
    return steps.join(own, "j").select("i", "j", xi.alias("xi"), F.try_divide(math.sqrt(n) * xi, F.sqrt(v)).alias("z"))


def xicor(pairs: DataFrame, n: int, compat: bool = False) -> DataFrame:
    """i, j, xi, z for rows (i, j, id, x, y) of pairs of columns, each column's values standing in every pair it is in."""
    x = pairs.select("id", F.col("i").alias("dim"), F.col("x").alias("value")).distinct()
    y = pairs.select("id", F.col("j").alias("dim"), F.col("y").alias("value")).distinct()
    return xicor_matrix(x, y, n, compat).join(pairs.select("i", "j").distinct(), ["i", "j"], "left_semi")


def rank_one_match(u: DataFrame, v: DataFrame, u_least: float = 0.0, v_least: float = 0.0) -> DataFrame:
    """rank (from 0), u_id, v_id: the r-th largest of one side with the r-th of the other, as far as both exceed their thresholds; ties by id."""

    def ranked(x: DataFrame, least: float, name: str) -> DataFrame:
        some = x.where(F.col("value") > least).select(F.col("id").alias(name), (-F.col("value")).alias("neg"), F.lit(1).alias("one"))
        return running(some, ["neg", name], {"one": "rank"}).select(F.col("rank").cast("long").alias("rank"), name)

    return ranked(u, u_least, "u_id").join(ranked(v, v_least, "v_id"), "rank")
