"""Graph layout by stochastic gradients: each epoch needs the whole state of the one before.

The edges (src, dst, weight) are filtered and counted by Spark. Layouts of at most `LIMIT` numbers go to one task with the edges kept; larger ones, and all with `rounds`, make each epoch a pass over the
edges in all tasks and a sum for each node. Up to `PLACES` numbers, the nodes' places are kept on the driver and sent to the tasks; beyond, edges are joined with them, at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matloom.operators.dense import rows_of
from matloom.plans.joins import broadcast_if_small
from matloom.plans.materialize import cut

LIMIT = 50_000_000
#: Numbers of places that the driver keeps (three times) and sends to all tasks, 8 bytes each, and as many of ids at most.
PLACES = 4_000_000
#: Edges that a task takes at once.
AT_ONCE = 1 << 15
METHODS = ("umap", "tumap", "largevis")


def find_ab(spread: float = 1.0, min_dist: float = 1.0) -> tuple[float, float]:
    """a, b for which 1 / (1 + a x^2b) comes nearest to a plateau up to min_dist and exponential decay beyond: damped Gauss-Newton on 300 points."""
    x = np.linspace(0, 3 * spread, 301)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p, damp = np.array([1.0, 1.0]), 1e-3

    def miss(p: np.ndarray) -> np.ndarray:
        return 1 / (1 + p[0] * x ** (2 * p[1])) - y

    for _ in range(200):
        r = miss(p)
        t = x ** (2 * p[1])
        f = -1 / (1 + p[0] * t) ** 2
        jac = np.stack([f * t, f * p[0] * t * 2 * np.log(x)], 1)
        h = jac.T @ jac
        step = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), -jac.T @ r)
        new = np.maximum(p + step, 1e-4)
        if (miss(new) ** 2).sum() < (r**2).sum():
            p, damp = new, damp / 3
            if np.abs(step).max() < 1e-10:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return float(p[0]), float(p[1])


def _gradients(method: str, a: float, b: float, gamma: float):
    """Attraction and repulsion as functions of the squared distance, and the clamp."""
    if method == "largevis":
        return lambda d: -2 / (1 + d), lambda d: 2 * gamma / ((0.1 + d) * (1 + d)), 5.0
    if method == "tumap":
        a = b = 1.0
    attract = lambda d: np.where(d > 0, -2 * a * b * np.maximum(d, 1e-300) ** (b - 1) / (1 + a * d**b), 0.0)
    return attract, lambda d: 2 * gamma * b / ((0.001 + d) * (1 + a * d**b)), 4.0


def optimize(y: np.ndarray, src: np.ndarray, dst: np.ndarray, every: np.ndarray, epochs: int, method: str = "umap", a: float = 1.0, b: float = 1.0, rate: float = 1.0, gamma: float = 1.0, negatives: int = 5, seed: int = 0, optimizer: str = "adam", beta1: float = 0.5, beta2: float = 0.9, eps: float = 1e-7, at_once: int = 0) -> np.ndarray:
    """Epochs of gradients: an edge acts once in `every` epochs, with `negatives` random nodes each; Adam or plain steps ("sgd") that shrink linearly. `at_once`: edges after which plain steps move the nodes in place; 0: all of an epoch, the only way with Adam."""
    if optimizer not in ("adam", "sgd") or at_once and optimizer != "sgd":
        raise ValueError("the optimizer is adam or sgd, and only sgd moves nodes in place")
    y, n, dim = np.array(y, float), *y.shape
    attract, repel, clamp = _gradients(method, a, b, gamma)
    rng = np.random.default_rng(seed)
    due = every.copy()
    m, v = np.zeros_like(y), np.zeros_like(y)
    for epoch in range(epochs):
        on = due <= epoch + 1
        due[on] += every[on]
        left = rate * (1 - epoch / epochs)
        turn = np.flatnonzero(on)
        if at_once:
            turn = rng.permutation(turn)
        for at in range(0, max(len(turn), 1), at_once or max(len(turn), 1)):
            some = turn[at : at + at_once] if at_once else turn
            i, j = src[some], dst[some]
            g = np.zeros_like(y)
            diff = y[i] - y[j]
            np.add.at(g, i, 2 * np.clip(attract((diff * diff).sum(1))[:, None] * diff, -clamp, clamp))
            heads = np.repeat(i, negatives)
            away = rng.integers(0, n, len(heads))
            diff = y[heads] - y[away]
            push = np.clip(repel((diff * diff).sum(1))[:, None] * diff, -clamp, clamp)
            push[heads == away] = 0
            np.add.at(g, heads, push)
            if optimizer == "adam":
                m, v = beta1 * m + (1 - beta1) * g, beta2 * v + (1 - beta2) * g * g
                y += left * (m / (1 - beta1 ** (epoch + 1))) / (np.sqrt(v / (1 - beta2 ** (epoch + 1))) + eps)
            else:
                y += left * g
    return y


def schedule(g: DataFrame, epochs: int) -> DataFrame:
    """src, dst, every: the edges (src, dst, weight) that act in `epochs` epochs, and once in how many; the heaviest acts in each, an edge too light to act once is left out. No edges give no rows."""
    top = g.agg(F.max("weight")).first()[0] or 1.0
    return g.where(F.col("weight") >= top / epochs).select("src", "dst", (top / F.col("weight")).alias("every"))


def _drawn(src: np.ndarray, dst: np.ndarray, salt: int, j: int, n: int) -> np.ndarray:
    """A number below n for each edge, by a mixing hash of its ends, the salt and j."""
    with np.errstate(over="ignore"):
        x = (src.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (dst.astype(np.uint64) + np.uint64((salt * 1_000_003 + j) % 2**64) * np.uint64(0xD1342543DE82EF95))
        for shift in (30, 27):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(n)).astype(np.int64)


def _gradient(src: np.ndarray, dst: np.ndarray, y: np.ndarray, to: np.ndarray, ids: np.ndarray, places: np.ndarray, salt: int, negatives: int, shape: tuple) -> np.ndarray:
    """What each edge gives its first end, which is at y, the other at `to`; nodes `ids` at `places` are to be pushed from."""
    attract, repel, clamp = _gradients(*shape)
    diff = y - to
    g = 2 * np.clip(attract((diff * diff).sum(1))[:, None] * diff, -clamp, clamp)
    for j in range(negatives if len(ids) else 0):
        some = _drawn(src, dst, salt, j, len(ids))
        diff = y - places[some]
        push = np.clip(repel((diff * diff).sum(1))[:, None] * diff, -clamp, clamp)
        push[ids[some] == src] = 0
        g += push
    return g


def _pulls(pairs: DataFrame, away: list, salt: int, negatives: int, shape: tuple) -> DataFrame:
    """id, g: the gradients that edges (src, dst, from, to) give their first ends, added up within a batch. `away`: nodes (id, y) to be pushed from."""
    ids, places = np.array([r["id"] for r in away], np.int64), np.array([r["y"] for r in away], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            src, dst, y = batch.column(0).to_numpy(), batch.column(1).to_numpy(), rows_of(batch.column(2))
            g = _gradient(src, dst, y, rows_of(batch.column(3)), ids, places, salt, negatives, shape)
            heads, at = np.unique(src, return_inverse=True)
            total = np.zeros((len(heads), y.shape[1]))
            np.add.at(total, at, g)
            flat = pa.array(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(heads) + 1) * y.shape[1], pa.int32()), flat)], names=["id", "g"])

    return pairs.mapInArrow(run, "id long, g array<double>")


def _acts(epoch: int) -> Column:
    """An edge acts where another multiple of its interval is reached; the little keeps rounding from deferring it."""
    return F.floor((epoch + 1) / F.col("every") + 1e-9) > F.floor(epoch / F.col("every") + 1e-9)


def _at_hand(edges: DataFrame, start: DataFrame, ids: np.ndarray, y: np.ndarray, epochs: int, shape: tuple, rate: float, negatives: int, seed: int, optimizer: str, betas: tuple[float, float], eps: float, pool: int) -> DataFrame:
    """_by_rounds() with the nodes' places (ids in order, y) on the driver: tasks look them up, so that an epoch shuffles sums only."""
    spark, (n, dims), (b1, b2) = start.sparkSession, y.shape, betas
    known = spark.sparkContext.broadcast(ids)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [batch.column(c).to_numpy() for c in (0, 1)]
            at = [np.minimum(np.searchsorted(known.value, x), n - 1) for x in ends]
            own = (known.value[at[0]] == ends[0]) & (known.value[at[1]] == ends[1])
            yield pa.RecordBatch.from_arrays([pa.array(at[0][own], pa.int32()), pa.array(at[1][own], pa.int32()), batch.column(2).filter(pa.array(own))], names=["src", "dst", "every"])

    # A node's edges stand together, so that it has one sum in an epoch, or few.
    edges = cut(edges.select("src", "dst", "every").mapInArrow(numbered, "src int, dst int, every double").repartition("src"), "edges")
    nodes = cut(start.select("id"), "nodes")
    m, v = np.zeros_like(y), np.zeros_like(y)
    for epoch in range(epochs):
        away = np.zeros(0, np.int64)
        if negatives:
            away = np.searchsorted(ids, np.array([r["id"] for r in nodes.orderBy(F.xxhash64("id", F.lit(seed), F.lit(epoch)), "id").limit(pool).collect()], np.int64))
        now = spark.sparkContext.broadcast(y)

        def pulled(batches: Iterator[pa.RecordBatch], epoch=epoch, now=now, away=away) -> Iterator[pa.RecordBatch]:
            places, names, total, met, held = now.value, known.value, np.zeros((n, dims)), np.zeros(n, bool), []

            def add() -> None:
                i, j = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                np.add.at(total, i, _gradient(names[i], names[j], places[i], places[j], names[away], places[away], seed * 1_000_003 + epoch, negatives, shape))
                met[i] = True
                held.clear()

            for batch in batches:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                if sum(len(h[0]) for h in held) >= AT_ONCE:
                    add()
            if held:
                add()
            at = np.flatnonzero(met)
            for a in range(0, len(at), 10_000):
                some = at[a : a + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(total[some, c]) for c in range(dims)]], names=["at", *[f"g{c}" for c in range(dims)]])

        sums = edges.where(_acts(epoch)).select("src", "dst").mapInArrow(pulled, ", ".join(["at int", *[f"g{c} double" for c in range(dims)]])).toArrow()
        now.destroy()
        g = np.zeros_like(y)
        for c in range(dims):
            g[:, c] = np.bincount(sums.column(0).to_numpy(), sums.column(c + 1).to_numpy(), n)
        left = rate * (1 - epoch / epochs)
        if optimizer == "adam":
            m, v = b1 * m + (1 - b1) * g, b2 * v + (1 - b2) * g * g
            y = y + left * (m / (1 - b1 ** (epoch + 1))) / (np.sqrt(v / (1 - b2 ** (epoch + 1))) + eps)
        else:
            y = y + left * g
    known.destroy()
    vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dims, pa.int32()), pa.array(y.ravel()))
    return cut(spark.createDataFrame(pa.table({"id": pa.array(ids), "vec": vec})), "laid")


def _by_rounds(edges: DataFrame, start: DataFrame, dims: int, epochs: int, shape: tuple, rate: float, negatives: int, seed: int, optimizer: str, betas: tuple[float, float], eps: float, pool: int) -> DataFrame:
    """`optimize` over tables. A node's negatives come from `pool` nodes, which each epoch draws anew from all by a hash."""
    (b1, b2), each = betas, range(dims)
    edges = cut(edges, "edges")
    state = cut(start.select("id", *[F.col("vec")[c].alias(f"y{c}") for c in each], *[F.lit(0.0).alias(f"{m}{c}") for m in "mv" for c in each]), "places")
    for epoch in range(epochs):
        on = edges.where(_acts(epoch)).select("src", "dst")
        y = state.select("id", F.array(*[f"y{c}" for c in each]).alias("y"))
        away = y.orderBy(F.xxhash64("id", F.lit(seed), F.lit(epoch)), "id").limit(pool).collect() if negatives else []
        y = broadcast_if_small(y)
        pairs = on.hint("merge").join(y.select(F.col("id").alias("src"), F.col("y").alias("from")), "src").hint("merge").join(y.select(F.col("id").alias("dst"), F.col("y").alias("to")), "dst").select("src", "dst", "from", "to")
        sums = _pulls(pairs, away, seed * 1_000_003 + epoch, negatives, shape).groupBy("id").agg(*[F.sum(F.col("g")[c]).alias(f"g{c}") for c in each])
        g = [F.coalesce(f"g{c}", F.lit(0.0)) for c in each]
        left = rate * (1 - epoch / epochs)
        if optimizer == "adam":
            m = [b1 * F.col(f"m{c}") + (1 - b1) * g[c] for c in each]
            v = [b2 * F.col(f"v{c}") + (1 - b2) * g[c] * g[c] for c in each]
            step = [left * (m[c] / (1 - b1 ** (epoch + 1))) / (F.sqrt(v[c] / (1 - b2 ** (epoch + 1))) + eps) for c in each]
        else:
            m, v, step = [F.col(f"m{c}") for c in each], [F.col(f"v{c}") for c in each], [left * x for x in g]
        new = [(F.col(f"y{c}") + step[c]).alias(f"y{c}") for c in each] + [x[c].alias(f"{n}{c}") for n, x in (("m", m), ("v", v)) for c in each]
        state = cut(state.join(sums, "id", "left").select("id", *new), "places", instead_of=state)
    return state.select("id", F.array(*[f"y{c}" for c in each]).alias("vec"))


def layout(g: DataFrame, start: DataFrame, method: str = "umap", components: int = 2, spread: float = 1.0, min_dist: float = 1.0, epochs: int = 0, rate: float = 1.0, gamma: float = 1.0, negatives: int = 5, a: float = 0.0, b: float = 0.0, seed: int = 0, optimizer: str = "adam", beta1: float = 0.5, beta2: float = 0.9, eps: float = 1e-7, at_once: int = 0, rounds: bool = False, pool: int = 4096) -> DataFrame:
    """id, vec of the laid-out nodes of `start` (id, vec, whose first components are the initial place).

    `rounds`: no task holds the edges, each epoch is a pass over them, and negatives come from `pool` nodes drawn anew each epoch. Without negatives both ways give the same places.
    Layouts of more than `LIMIT` numbers are made by rounds, but for those that move nodes `at_once`, which need one task and raise an error.
    """
    if method not in METHODS:
        raise ValueError(f"the method is one of {', '.join(METHODS)}")
    if rounds and (at_once or optimizer not in ("adam", "sgd")):
        raise ValueError("rounds take adam or sgd, and move all nodes at once")
    n = start.count()
    epochs = epochs or (500 if n <= 10_000 else 200)
    fit = find_ab(spread, min_dist)
    a, b = a or fit[0], b or fit[1]
    edges = schedule(g, epochs)
    size = 0 if rounds else edges.count() + n * components
    if size > LIMIT and at_once:
        raise ValueError(f"{size} numbers are more than {LIMIT}")
    if rounds or size > LIMIT:
        how = (epochs, (method, a, b, gamma), rate, negatives, seed, optimizer, (beta1, beta2), eps, pool)
        if 0 < n * components <= PLACES:
            held = start.select("id", F.slice("vec", 1, components).alias("vec")).toArrow()
            ids, y = held.column(0).to_numpy(), rows_of(held.column(1).combine_chunks())
            ids, at = np.unique(ids, return_index=True)
            if len(ids) == n:
                return _at_hand(edges, start, ids.astype(np.int64), y[at], *how)
        return _by_rounds(edges, start, components, *how)
    own = start.select(F.lit(0).alias("kind"), "id", F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("every"), F.slice("vec", 1, components).alias("vec"))
    rows = own.union(edges.select(F.lit(1), F.col("src"), "dst", "every", F.lit(None).cast("array<double>"))).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, ends = [], [], []
        for batch in batches:
            kind = batch.column(0).to_numpy()
            own, links = batch.filter(pa.array(kind == 0)), batch.filter(pa.array(kind == 1))
            ids.append(own.column(1).to_numpy())
            starts.append(rows_of(own.column(4)))
            ends.append(np.stack([links.column(c).to_numpy(zero_copy_only=False).astype(np.float64 if c == 3 else np.int64) for c in (1, 2, 3)], 0) if links.num_rows else np.zeros((3, 0)))
        ids = np.concatenate([*ids, np.zeros(0, np.int64)])
        if not len(ids):
            return
        order = np.argsort(ids, kind="stable")
        ids, y, edges = ids[order], np.concatenate([x for x in starts if len(x)])[order], np.concatenate(ends, 1)
        edges = edges[:, np.lexsort((edges[1], edges[0]))]
        src, dst = [np.searchsorted(ids, edges[c].astype(np.int64)) for c in (0, 1)]
        y = optimize(y, src, dst, edges[2], epochs, method, a, b, rate, gamma, negatives, seed, optimizer, beta1, beta2, eps, at_once)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(y.tolist(), pa.list_(pa.float64()))], names=["id", "vec"])

    return rows.mapInArrow(run, "id long, vec array<double>")
