"""Diffusion, label propagation, enrichment and cores on an edge table (src, dst, weight).

Iterations are joins and sums over edges; each writes its vector and starts the next from files, so that lineage stays short and a lost
executor costs one step. Columns of seeds (dim) are spread together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matloom.operators.coo import normalize, normalize_graph
from matloom.operators.linalg import sum_of
from matloom.plans.components import components
from matloom.plans.materialize import cut
from matloom.plans.prefix import running

#: Edges that one task goes through, a few numbers for each.
ONE_TASK = 2_000_000


#: Columns of seeds that are spread at once, as one array a node.
TOGETHER = 64


def column_groups(x: DataFrame) -> list[list]:
    """The columns of x (id, dim, value), in order, TOGETHER at a time. Their names alone come to the driver; each group is a run of its own."""
    dims = sorted(r[0] for r in x.select("dim").distinct().collect())
    return [dims[i : i + TOGETHER] for i in range(0, len(dims), TOGETHER)]


def arrays(x: DataFrame, dims: list, keys: list[str]) -> DataFrame:
    """keys and vec: the values of x (keys, dim, value) in the columns `dims`, zeros where there are none."""
    have = x.where(F.col("dim").isin(dims)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("m"))
    return have.select(*keys, F.array(*[F.coalesce(F.try_element_at("m", F.lit(d)), F.lit(0.0)) for d in dims]).alias("vec"))


def _wide(nodes: DataFrame, x: DataFrame, dims: list, name: str = "vec") -> DataFrame:
    """id and an array of a node's values in the columns `dims` of x (id, dim, value), zeros where it has none."""
    return nodes.select("id").join(arrays(x, dims, ["id"]), "id", "left").select("id", F.coalesce("vec", F.array(*[F.lit(0.0)] * len(dims))).alias(name))


def _long(x: DataFrame, dims: list, kind) -> DataFrame:
    return x.select("id", F.explode(F.arrays_zip(F.array(*map(F.lit, dims)).alias("dim"), F.col("vec").alias("value"))).alias("e")).select("id", F.col("e.dim").cast(kind).alias("dim"), F.col("e.value").alias("value"))


def each(f: Callable[[int], Column], width: int) -> Column:
    return F.array(*[f(d) for d in range(width)])


def _step(p: DataFrame, x: DataFrame, width: int, name: str = "vec") -> DataFrame:
    """id, w: edges times the arrays of x (id, and `name`). Sums are partial before they are shuffled."""
    return p.join(x.select(F.col("id").alias("dst"), F.col(name).alias("x")), "dst").groupBy(F.col("src").alias("id")).agg(each(lambda d: F.sum(F.col("weight") * F.col("x")[d]), width).alias("w"))


def _or_zero(c: str, width: int) -> Column:
    return F.coalesce(F.col(c), F.array(*[F.lit(0.0)] * width))


def _by_groups(x0: DataFrame, run: Callable[[list], DataFrame]) -> DataFrame:
    """The columns of all groups, each spread by `run`."""
    out = None
    for dims in column_groups(x0):
        got = _long(run(dims), dims, x0.schema["dim"].dataType)
        out = got if out is None else out.union(got)
    return x0.limit(0) if out is None else out


def diffuse(g: DataFrame, nodes: DataFrame, x0: DataFrame, alpha: float = 0.85, rounds: int = 5, method: int = 0) -> DataFrame:
    """Personalised PageRank of the seeds (id, dim, value), each column made to sum to one (a column of zeros stays one); `alpha` is the share of the walk. Isolated nodes gain mass with methods 0 and 1."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies in [0, 1]")
    if alpha == 0:
        return x0
    n = nodes.count()
    p = cut(normalize_graph(g, nodes, method), "walk")
    linked = g.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("s")).where("s > 0").select("id", F.lit(True).alias("has"))
    z = nodes.join(linked, "id", "left").select("id", (F.when(F.col("has"), 1 - alpha).otherwise(1.0) / n).alias("z"))
    seeds = cut(normalize(x0, "dim"), "seeds")

    def run(dims: list) -> DataFrame:
        width = len(dims)
        x = first = cut(_wide(nodes, seeds, dims, "v0").join(z, "id").select("id", "z", "v0", F.col("v0").alias("vec")), "spread")
        for _ in range(rounds):
            lost = x.agg(*[F.sum(F.col("z") * F.col("vec")[d]) for d in range(width)]).first()
            new = x.join(_step(p, x, width), "id", "left").withColumn("w", _or_zero("w", width))
            new = new.select("id", "z", "v0", each(lambda d: alpha * F.col("w")[d] + F.lit(n * float(lost[d] or 0.0)) * F.col("v0")[d], width).alias("vec"))
            x = cut(new, "spread", x if x is not first else None)
        return x

    return _by_groups(seeds, run)


def diffuse_chebyshev(g: DataFrame, nodes: DataFrame, x0: DataFrame, alpha: float = 0.85, rounds: int = 5, method: int = 0, tol: float = 1e-8) -> DataFrame:
    """The same by Chebyshev's recurrence; seeds are not made to sum to one. Stops when the change of a group of columns, as a matrix, has a norm below `tol`."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies in [0, 1]")
    if alpha == 0:
        return x0
    a = 1 - alpha
    p = cut(normalize_graph(g, nodes, method), "walk")

    def run(dims: list) -> DataFrame:
        width = len(dims)

        def next_of(y: DataFrame, f: Callable[[int], Column]) -> DataFrame:
            """id, v0, prev (the array so far) and vec (f of a place) from y (id, v0, prev, vec) and its step w."""
            joined = y.join(_step(p, y, width), "id", "left").withColumn("w", _or_zero("w", width))
            return joined.select("id", "v0", F.col("vec").alias("prev"), each(f, width).alias("vec"))

        first = _wide(nodes, x0, dims, "v0").select("id", "v0", F.col("v0").alias("prev"), F.col("v0").alias("vec"))
        y = cut(next_of(cut(first, "spread"), lambda d: alpha * F.col("w")[d] + a * F.col("v0")[d]), "spread")
        m0, m1 = 1.0, 1 / alpha
        for _ in range(max(rounds, 0)):
            m = 2 * m1 / alpha - m0
            y = cut(next_of(y, lambda d: 2 * m1 / m * F.col("w")[d] - m0 / m * F.col("prev")[d] + 2 * m1 / (alpha * m) * a * F.col("v0")[d]), "spread", y)
            if tol > 0 and _spectral(y, width) < tol:
                break
            m0, m1 = m1, m
        return y

    got = _by_groups(x0, run)
    if x0.agg(F.min("value")).first()[0] >= 0:
        got = got.withColumn("value", F.greatest("value", F.lit(0.0)))
    return got


def _spectral(y: DataFrame, width: int) -> float:
    """The largest singular value of vec - prev, from the products of its few columns."""

    def work(now: np.ndarray, before: np.ndarray) -> np.ndarray:
        return (now - before).T @ (now - before)

    g = sum_of(y.select("vec", "prev"), work, width * width).reshape(width, width)
    return float(np.sqrt(max(0.0, np.linalg.eigvalsh(g)[-1])))


def diffuse_solved(g: DataFrame, nodes: DataFrame, x0: DataFrame, alpha: float = 0.85, tol: float = 1e-10, rounds: int = 200) -> DataFrame:
    """id, dim, value with value = alpha P value + (1 - alpha) x0, P being the graph whose columns sum to one (an isolated node's are zero) and the columns of x0 made to sum to one: the walk's limit, by stabilised biconjugate gradients.

    Columns go together, each with numbers of its own, until every residual's length is below `tol`. A round is two products with the edges, each from a written table.
    """
    if not 0 <= alpha < 1:
        raise ValueError("alpha lies in [0, 1)")
    p = cut(normalize(g.select(F.col("src").alias("row_id"), F.col("dst").alias("col_id"), F.col("weight").alias("value"))).select(F.col("row_id").alias("src"), F.col("col_id").alias("dst"), F.col("value").alias("weight")), "walk")
    seeds = cut(normalize(x0, "dim"), "seeds")

    def run(dims: list) -> DataFrame:
        width = len(dims)
        at = lambda c: lambda d: F.col(c)[d]
        lit = lambda numbers: lambda d: F.lit(float(numbers[d]))

        def applied(rows: DataFrame, of: str, to: str) -> DataFrame:
            """`rows` with `to`: (I - alpha P) times the arrays `of`."""
            joined = rows.join(_step(p, rows, width, of), "id", "left").withColumn("w", _or_zero("w", width))
            return joined.withColumn(to, each(lambda d: F.col(of)[d] - alpha * F.col("w")[d], width)).drop("w")

        def sums(rows: DataFrame, *pairs: tuple[str, str]) -> np.ndarray:
            got = rows.agg(*[F.sum(F.col(a)[d] * F.col(b)[d]) for a, b in pairs for d in range(width)]).first()
            return np.array([x or 0.0 for x in got]).reshape(len(pairs), width)

        over = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b != 0)
        b = _wide(nodes, seeds, dims, "b").withColumn("x", each(lambda d: (1 - alpha) * F.col("b")[d], width))
        state = cut(applied(cut(b, "solve"), "x", "ax").select("id", "x", each(lambda d: F.col("x")[d] - F.col("ax")[d], width).alias("r")).select("id", "x", "r", F.col("r").alias("hat"), F.col("r").alias("p"), each(lambda d: F.lit(0.0), width).alias("v")), "solve")
        rho = sums(state, ("r", "r"))[0]
        size, beta, omega = rho.copy(), np.zeros(width), np.zeros(width)
        for _ in range(rounds):
            if (np.sqrt(size) <= tol).all():
                break
            new_p = each(lambda d: at("r")(d) + lit(beta)(d) * (at("p")(d) - lit(omega)(d) * at("v")(d)), width)
            half = cut(applied(state.withColumn("p", new_p).drop("v"), "p", "v"), "solve")
            step = over(rho, sums(half, ("hat", "v"))[0])
            with_s = half.withColumn("s", each(lambda d: at("r")(d) - lit(step)(d) * at("v")(d), width)).drop("r")
            whole = cut(applied(with_s, "s", "t"), "solve", state)
            ts, tt, hs, ht, ss = sums(whole, ("t", "s"), ("t", "t"), ("hat", "s"), ("hat", "t"), ("s", "s"))
            omega = over(ts, tt)
            size = np.maximum(0.0, ss - 2 * omega * ts + omega**2 * tt)
            new_rho = hs - omega * ht
            beta, rho = over(new_rho, rho) * over(step, omega), new_rho
            x = each(lambda d: at("x")(d) + lit(step)(d) * at("p")(d) + lit(omega)(d) * at("s")(d), width)
            r = each(lambda d: at("s")(d) - lit(omega)(d) * at("t")(d), width)
            state = cut(whole.select("id", x.alias("x"), r.alias("r"), "hat", "p", "v"), "solve", whole)
        return state.select("id", F.col("x").alias("vec"))

    return _by_groups(seeds, run)


def _totals(g: DataFrame) -> DataFrame:
    """id, r, q, a: a node's weights' sum, sum of squares and largest."""
    return g.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("r"), F.sum(F.col("weight") ** 2).alias("q"), F.max("weight").alias("a"))


def label_enrichment(g: DataFrame, labels: DataFrame, nodes: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """id, label, score: how far a node's weight to a label exceeds what the label's share would give (an upper bound of a tail, in natural logs). Pairs without weight score 0 and have no row. `totals` of the same graph may be at hand."""
    n = nodes.count()
    some = labels.where(F.col("label") >= 0)
    share = some.groupBy("label").agg((F.count(F.lit(1)) / n).alias("p"))
    seen = g.join(some.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("weight").alias("o"))
    rows = _totals(g) if totals is None else totals
    over = F.col("o") - F.col("r") * F.col("p")
    score = F.when(over > 0, F.try_divide(over * over, 2 * (F.col("q") * F.col("p") + F.col("a") * over / 3))).otherwise(0.0)
    return seen.join(rows, "id").join(share, "label").select("id", "label", F.coalesce(score, F.lit(0.0)).alias("score"))


def propagate(g: DataFrame, nodes: DataFrame, labels: DataFrame, fixed: DataFrame | None = None, self_weight: float = 0.0, rounds: int = 3, least: float = 3.0) -> DataFrame:
    """id, label: a node takes the label with the highest enrichment if that exceeds `least` (ties: the smaller label); fixed nodes keep theirs. Null or negative labels are none. Self-loops weigh `self_weight`, whatever the graph has."""
    n = nodes.count()
    g = g.where("src <> dst").select("src", "dst", "weight")
    if self_weight:
        g = g.unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(self_weight).alias("weight")))
    t = cut(normalize_graph(g, nodes, 1).withColumn("weight", F.col("weight") * n), "walk")
    start = nodes.join(labels, "id", "left").select("id", F.coalesce("label", F.lit(-1)).cast("int").alias("label"))
    now, totals = cut(start, "labels"), cut(_totals(t), "totals")
    held = fixed.select("id", F.lit(True).alias("held")).join(start.withColumnRenamed("label", "own"), "id") if fixed is not None else None
    for _ in range(rounds):
        best = label_enrichment(t, now, nodes, totals).where(F.col("score") > least).groupBy("id").agg(F.max(F.struct("score", (-F.col("label")).alias("neg"))).alias("b")).select("id", (-F.col("b.neg")).alias("new"))
        moved = now.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label"))
        if held is not None:
            moved = moved.join(held, "id", "left").select("id", F.when(F.col("held"), F.col("own")).otherwise(F.col("label")).alias("label"))
        now = cut(moved.select("id", F.col("label").cast("int").alias("label")), "labels", now)
    return now


def _peeled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, core of a whole edge list (src, dst) at once, by the same rounds as coreness()."""
    parts = [np.stack([b.column(i).to_numpy() for i in (0, 1)]) for b in batches if b.num_rows]
    if not parts:
        return
    ends = np.concatenate(parts, 1)
    ids, place = np.unique(ends, return_inverse=True)
    src, dst = place.reshape(ends.shape)
    core = np.bincount(src, minlength=len(ids))
    while True:
        near = core[dst]
        order = np.lexsort((-near, src))
        first = np.flatnonzero(np.diff(src[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order))) + 1
        new, at = core.copy(), src[order][first]
        new[at] = np.minimum(core[at], np.maximum.reduceat(np.minimum(near[order], rank), first))
        if (new == core).all():
            break
        core = new
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(core, pa.int64())], names=["id", "core"])


def coreness(g: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, core: every node's number is lowered to the h-index of its neighbours' numbers until none changes.

    The h-index counts, from the largest down, a histogram of neighbours' numbers, so a node with many neighbours is summed before it is shuffled. Up to `ONE_TASK` edges
    the rounds are gone through in one task.
    """
    edges = cut(g.select("src", "dst").distinct(), "edges")
    if edges.limit(ONE_TASK + 1).count() <= ONE_TASK:
        got = edges.coalesce(1).mapInArrow(_peeled, "id long, core long")
        return nodes.join(got, "id", "left").select("id", F.coalesce("core", F.lit(0).cast("long")).alias("core"))
    degrees = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("core"))
    now = cut(nodes.join(degrees, "id", "left").select("id", F.coalesce("core", F.lit(0)).alias("core"), F.lit(True).alias("moved")), "cores")
    while True:
        # Only nodes beside one whose number has just fallen can fall.
        touched = edges.join(now.where("moved").select(F.col("id").alias("dst")), "dst", "left_semi").select("src").distinct()
        near = edges.join(touched, "src", "left_semi").join(now.select(F.col("id").alias("dst"), "core"), "dst")
        seen = near.groupBy("src", "core").agg(F.count(F.lit(1)).alias("n"))
        down = Window.partitionBy("src").orderBy(F.col("core").desc())
        h = seen.withColumn("m", F.sum("n").over(down)).groupBy(F.col("src").alias("id")).agg(F.max(F.least("core", "m")).alias("h"))
        low = F.least("core", F.coalesce("h", "core"))
        now = cut(now.join(h, "id", "left").select("id", low.alias("core"), (low < F.col("core")).alias("moved")), "cores", now)
        if not now.where("moved").limit(1).count():
            return now.select("id", "core")


def centrality(g: DataFrame, groups: DataFrame) -> DataFrame:
    """id, centrality: the core number within a node's own group (id, label), over the group's sample deviation (0 counts as 1)."""
    a, b = groups.select(F.col("id").alias("src"), F.col("label").alias("la")), groups.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    inside = g.join(a, "src").join(b, "dst").where("la = lb").select("src", "dst", "weight")
    cores = coreness(inside, groups.select("id")).join(groups, "id")
    sd = F.coalesce(F.stddev_samp("core").over(Window.partitionBy("label")), F.lit(0.0))
    return cores.select("id", (F.col("core") / F.when(sd == 0, 1.0).otherwise(sd)).alias("centrality"))


def dense_regions(g: DataFrame, nodes: DataFrame, least: int = 5, eps: float = 0.5, alpha: float = 0.85, scores: DataFrame | None = None) -> DataFrame:
    """id, label, core: clusters of a symmetric graph by density. A core has `least` neighbours or more by edges heavier than `eps`; cores so joined are one cluster, numbered from 1 in the order of their
    first cores; a node beside cores belongs to the first cluster that reaches it; all others are noise, label 0. Self-loops are left out.

    The order is that of `scores` (id, score), the largest first and ties by id: the nodes' core numbers, spread over the graph for three rounds, unless others are given.
    """
    g = g.where("src <> dst")
    if scores is None:
        cores_of = coreness(g, nodes).select("id", F.lit(0).alias("dim"), F.col("core").cast("double").alias("value"))
        scores = diffuse(g, nodes, cores_of, alpha, 3).select("id", F.col("value").alias("score"))
    order = running(nodes.select("id").join(scores, "id", "left").select("id", (-F.coalesce("score", F.lit(0.0))).alias("neg"), F.lit(1).alias("one")), ["neg", "id"], {"one": "place"})
    heavy = cut(g.where(F.col("weight") > eps).select("src", "dst"), "heavy")
    cores = heavy.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("id")
    cores = cut(cores.join(order.select("id", "place"), "id"), "cores")
    inner = heavy.join(cores.select(F.col("id").alias("src")), "src", "left_semi").join(cores.select(F.col("id").alias("dst")), "dst", "left_semi")
    joined = components(inner.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v")), "regions")
    of_core = cores.join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", "place", F.coalesce("component", "id").alias("component"))
    firsts = of_core.groupBy("component").agg(F.min("place").alias("first"), F.lit(1).alias("one"))
    numbers = running(firsts, ["first"], {"one": "label"}).select("component", (F.col("label") + 1).cast("int").alias("label"))
    of_core = cut(of_core.join(numbers, "component").select("id", "label"), "regions")
    beside = heavy.join(of_core.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("beside"))
    return nodes.select("id").join(of_core, "id", "left").join(beside, "id", "left").select("id", F.coalesce("label", "beside", F.lit(0)).cast("int").alias("label"), F.col("label").isNotNull().alias("core"))


def sweep(g: DataFrame, scores: DataFrame, least: int = 1) -> DataFrame:
    """size, id, conductance of the sets of the nodes with the largest scores (id, score; ties by id), from `least` nodes on: the weight that leaves the set over the lesser of its weight and the rest's, of a symmetric graph without its self-loops. Null where one side weighs nothing.

    An edge counts as inner from its later end on, so that volumes and inner weights are running sums over range partitions.
    """
    g = g.where("src <> dst")
    place = running(scores.select("id", (-F.col("score")).alias("neg"), F.lit(1).alias("one")), ["neg", "id"], {"one": "place"}).select("id", F.col("place").cast("long").alias("place"))
    place = cut(place, "places")
    weight = g.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("w"))
    ends = g.join(place.select(F.col("id").alias("src"), F.col("place").alias("a")), "src").join(place.select(F.col("id").alias("dst"), F.col("place").alias("b")), "dst")
    inner = ends.groupBy(F.greatest("a", "b").alias("place")).agg(F.sum("weight").alias("inner"))
    rows = place.join(weight, "id", "left").join(inner, "place", "left").select("place", "id", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("inner", F.lit(0.0)).alias("inner"))
    summed = running(rows, ["place"], {"w": "vol", "inner": "inside"}).select((F.col("place") + 1).alias("size"), "id", (F.col("vol") + F.col("w")).alias("vol"), (F.col("inside") + F.col("inner")).alias("inside"))
    whole = g.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("whole"))
    found = summed.where(F.col("size") >= least).join(F.broadcast(whole), F.lit(True))
    return found.select("size", "id", F.try_divide(F.col("vol") - F.col("inside"), F.least("vol", F.col("whole") - F.col("vol"))).alias("conductance"))
