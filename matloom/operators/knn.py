"""Neighbours, exact or from a candidate index, and the graphs made of them.

Exact neighbours are found in a grid of blocks: a cell of the grid holds one block of rows and streams a share of
all others past it, keeping the k nearest of each row; a window merges the k of each share. That is every row with every other, as the graphs have it unless
the caller asks for a recall: `approximate` then deals rows into cells around centres, and a row looks into the cells nearest to it only, as many as that recall
takes by a measurement on some rows, with exact distances there. `descend` improves short lists through neighbours of neighbours. Distances are
`l2` (squared), `ip` (one minus the product) and `jsd` (the root of the Jensen-Shannon divergence in bits, plus half of any missing mass).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matloom.operators.dense import rows_of
from matloom.plans.joins import broadcast_if_small
from matloom.plans.materialize import cut, drop_shuffles

BLOCK, TILE, SPARE = 1024, 4096, 16
#: Rows of a block of the grid, at most, and the neighbours that a block holds, about: each block has all other rows sent to it.
ROWS, HELD = 8192, 8 << 20
#: Blocks a core for which all other rows are shuffled at a time.
WAVE = 2
METRICS = ("l2", "ip", "jsd")


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log2(np.maximum(x, 1e-300))


def exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances along the last axis, where both are rows of the same shape but for broadcasting."""
    if metric == "ip":
        return 1.0 - (a * b).sum(-1)
    if metric == "l2":
        return ((b - a) ** 2).sum(-1)
    # The missing mass stands outside of the floor at zero.
    lost = 0.5 * np.maximum(0.0, 1 - a.sum(-1)) + 0.5 * np.maximum(0.0, 1 - b.sum(-1))
    return np.sqrt(np.maximum(0.0, 0.5 * _plogp(a).sum(-1) + 0.5 * _plogp(b).sum(-1) - _plogp((a + b) / 2).sum(-1)) + lost)


def tile(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Distances of all rows of a from all of b, and a bound of their error: products of matrices where the distance allows them, for choosing which to compute exactly."""
    if metric == "ip":
        return 1.0 - a @ b.T, 1e-13 * (1 + float(np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * a.shape[1])
    if metric == "l2":
        p, q = (a * a).sum(1), (b * b).sum(1)
        return p[:, None] + q[None, :] - 2 * (a @ b.T), 1e-13 * float(p.max(initial=0) + q.max(initial=0) + 1)
    own = [0.5 * _plogp(x).sum(1) for x in (a, b)]
    lost = [0.5 * np.maximum(0.0, 1 - x.sum(1)) for x in (a, b)]
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        out[i] = np.maximum(0.0, own[0][i] + own[1] - _plogp((b + row) / 2).sum(1)) + (lost[0][i] + lost[1])
    return np.sqrt(out), 0.0


def nearest(x: np.ndarray, ids: np.ndarray, y: np.ndarray, names: np.ndarray, k: int, metric: str, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Exact distances and names of the k nearest rows of y for each row of x, in order, ties to the smaller name; infinite where there are fewer. With `same`, a row is not its own neighbour.

    A few more than k are chosen by the tile and computed exactly. Rows where those left out are not clearly farther, as among many equal ones, are computed in full.
    """
    d, error = tile(x, y, metric)
    if same:
        d[ids[:, None] == names[None, :]] = np.inf
    wide = min(k + SPARE, len(y))
    if wide < len(y):
        some = np.argpartition(d, wide - 1, axis=1)[:, :wide]
        near = np.take_along_axis(d, some, 1)
        kth = np.partition(near, min(k, wide) - 1, axis=1)[:, min(k, wide) - 1]
        unclear = np.flatnonzero(~(near.max(1) > kth + 2 * error))
    else:
        some, near, unclear = np.broadcast_to(np.arange(len(y)), d.shape), d, np.zeros(0, int)
    real = np.where(np.isfinite(near), near, np.inf)
    if metric != "jsd":
        for i in range(0, len(x), 64):
            real[i : i + 64] = np.where(np.isfinite(near[i : i + 64]), exact(x[i : i + 64, None, :], y[some[i : i + 64]], metric), np.inf)
    who = names[some]
    order = np.lexsort((who, real), axis=1)[:, :k]
    real, who = np.take_along_axis(real, order, 1), np.take_along_axis(who, order, 1)
    for i in unclear.tolist():
        full = np.where(np.isfinite(d[i]), exact(x[i], y, metric), np.inf)
        best = np.lexsort((names, full))[:k]
        real[i], who[i] = full[best], names[best]
    return real, who


def _single_error(mass: np.ndarray, masses: np.ndarray, wide: int) -> float:
    """A bound of the error of divergences in single precision."""
    most = max(1e-30, (mass.max() + masses.max()) / 2)
    return 1.5 * 6e-8 * (wide + 32) * most * (math.log(wide) + abs(math.log(most)) + 1) + 1e-9


def _lower(a: np.ndarray, b: np.ndarray, metric: str, kth: np.ndarray) -> tuple[np.ndarray, float]:
    """Lower bounds of the distances of all rows of a from all of b, and how far the distances can be above them; infinite bounds where a distance surely is above the row's `kth`.

    Divergences are first bounded by the roots' products, (|a| + |b|) / 2 - sum sqrt(a b), and worked out in single precision where that leaves them open.
    """
    if metric != "jsd" or not len(a) or not len(b) or a.min() < 0 or b.min() < 0:
        d, error = tile(a, b, metric)
        return np.subtract(d, error, out=d), 2 * error
    mass, masses = a.sum(1), b.sum(1)
    error = _single_error(mass, masses, a.shape[1])
    lost = [0.5 * np.maximum(0.0, 1 - x) for x in (mass, masses)]
    far = kth * kth
    roots = (mass[:, None] + masses[None, :]) / 2 - np.sqrt(a) @ np.sqrt(b).T + lost[0][:, None] + lost[1][None, :]
    own, theirs = 0.5 * _plogp(a).sum(1), 0.5 * _plogp(b).sum(1)
    halves, rows = (b / 2).astype(np.float32), (a / 2).astype(np.float32)
    out = np.full((len(a), len(b)), np.inf)
    for i, row in enumerate(rows):
        some = np.flatnonzero(roots[i] <= far[i] + 1e-9)
        m = halves[some] if len(some) < len(b) else halves.copy()
        m += row
        np.maximum(m, np.float32(1e-30), out=m)
        mixed = np.einsum("ij,ij->i", m, np.log(m)).astype(np.float64) / math.log(2)
        out[i, some] = np.maximum(0.0, np.maximum(0.0, own[i] + theirs[some] - mixed) + (lost[0][i] + lost[1][some]) - error)
    return np.sqrt(out), math.sqrt(2 * error)


def _nearer(a: np.ndarray, b: np.ndarray, metric: str, limit: np.ndarray) -> np.ndarray | None:
    """Which rows of b may be at most `limit` from each row of a: all that are, and few others. Products are in single precision with a bound of their error; nothing comes back where that is too coarse."""
    p, q = (a * a).sum(1), (b * b).sum(1)
    longest = math.sqrt(float(p.max()) * float(q.max()))
    error = (a.shape[1] + 8) * 2.0**-23 * (longest + float(q.max()) / 2) + 1e-30
    if not error < 1e15 or metric == "l2" and 2 * error > 0.01 * float(np.median(limit)):
        return None
    if metric == "l2":
        # p + q - 2ab <= limit, as one product with a column more.
        left, right = np.column_stack([a, np.ones(len(a))]), np.column_stack([b, -q / 2])
        least = (p - limit) / 2 - error
    else:
        left, right, least = a, b, 1 - limit - error
    s = left.astype(np.float32) @ right.astype(np.float32).T
    return s >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]


def _nearer_jsd(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows of a and of b whose divergence may be at most the former's `limit`, as in _lower(): all that are, and few others. The roots' products are in single precision too, with a bound of their error; nothing comes back where that is too coarse."""
    if a.min() < 0 or b.min() < 0:
        return None
    mass, masses = a.sum(1), b.sum(1)
    lost = [0.5 * np.maximum(0.0, 1 - x) for x in (mass, masses)]
    beside, far = masses / 2 + lost[1], limit * limit
    rough = (a.shape[1] + 9) * 2.0**-23 * (math.sqrt(float(mass.max()) * float(masses.max())) + float(beside.max())) + 1e-9
    if not rough < 0.01 * float(np.median(far)):
        return None
    left, right = np.column_stack([np.sqrt(a), np.ones(len(a))]).astype(np.float32), np.column_stack([np.sqrt(b), -beside]).astype(np.float32)
    least = np.nextafter((mass / 2 + lost[0] - far - rough).astype(np.float32), np.float32(-np.inf))
    i, j = np.divmod(np.flatnonzero((left @ right.T >= least[:, None]).ravel()), len(b))
    error = _single_error(mass, masses, a.shape[1])
    own, theirs = 0.5 * _plogp(a).sum(1), 0.5 * _plogp(b).sum(1)
    rows, halves = (a / 2).astype(np.float32), (b / 2).astype(np.float32)
    near = np.empty(len(i), bool)
    for at in range(0, len(i), 2 * TILE):
        p, q = i[at : at + 2 * TILE], j[at : at + 2 * TILE]
        m = halves[q]
        m += rows[p]
        np.maximum(m, np.float32(1e-30), out=m)
        mixed = np.einsum("ij,ij->i", m, np.log(m)).astype(np.float64) / math.log(2)
        near[at : at + 2 * TILE] = np.maximum(0.0, own[p] + theirs[q] - mixed) + (lost[0][p] + lost[1][q]) - error <= far[p] * (1 + 1e-12)
    return i[near], j[near]


class _Best:
    """The k nearest so far of some rows x: exact distances and names, in no order, infinite where there are fewer."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, metric: str, same: bool):
        self.ids, self.x, self.k, self.metric, self.same = ids, x, k, metric, same
        self.near, self.who = np.full((len(ids), k + k // 4 + SPARE), np.inf), np.zeros((len(ids), k + k // 4 + SPARE), np.int64)
        self.count, self.kth = np.zeros(len(ids), np.int64), np.full(len(ids), np.inf)

    def see(self, names: np.ndarray, y: np.ndarray) -> None:
        """Takes in rows y. Only those whose bound is below a row's k-th distance are computed exactly."""
        if not self.k:
            return
        i, j = self._open(names, y)
        limit = self.limit
        real = np.empty(len(i))
        for at in range(0, len(i), 8 * TILE):
            some = slice(at, at + 8 * TILE)
            real[some] = exact(self.x[i[some]], y[j[some]], self.metric)
        keep = real <= limit[i]
        i, j, real = i[keep], j[keep], real[keep]
        more = np.bincount(i, minlength=len(self.ids))
        if (self.count + more).max(initial=0) > self.near.shape[1]:
            self.settle()
            if (lack := int((self.count + more).max()) - self.near.shape[1]) > 0:
                self.near = np.pad(self.near, ((0, 0), (0, lack)), constant_values=np.inf)
                self.who = np.pad(self.who, ((0, 0), (0, lack)))
        at = self.count[i] + np.arange(len(i)) - (np.cumsum(more) - more)[i]
        self.near[i, at], self.who[i, at] = real, names[j]
        self.count += more
        if (np.isinf(self.kth) & (self.count >= self.k)).any():
            self.settle()

    def _open(self, names: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and new rows that are not surely farther apart than the row's `limit`, which is set here."""
        if self.metric != "jsd" and len(y) and np.isfinite(self.kth).all() and (some := _nearer(self.x, y, self.metric, self.kth)) is not None:
            self.limit = self.kth
            i, j = np.divmod(np.flatnonzero(some.ravel()), len(y))
            if self.same:
                other = self.ids[i] != names[j]
                i, j = i[other], j[other]
            return i, j
        if self.metric == "jsd" and len(y) and np.isfinite(self.kth).all() and (found := _nearer_jsd(self.x, y, self.kth)) is not None:
            self.limit, (i, j) = self.kth, found
            if self.same:
                other = self.ids[i] != names[j]
                i, j = i[other], j[other]
            return i, j
        low, slack = _lower(self.x, y, self.metric, self.kth)
        if self.same and len(own := np.flatnonzero(np.isin(names, self.ids))):
            low[:, own] = np.where(self.ids[:, None] == names[None, own], np.inf, low[:, own])
        self.limit = limit = np.minimum(self.kth, np.finfo(float).max)
        if len(new := np.flatnonzero(np.isinf(self.kth))) and len(y) > self.k:
            limit[new] = np.minimum(limit[new], np.partition(low[new], self.k - 1, axis=1)[:, self.k - 1] + slack)
        return np.nonzero(low <= limit[:, None])

    def settle(self) -> None:
        """Leaves the k nearest of each row, ties to the smaller name."""
        k = self.k
        over = np.flatnonzero(self.count > k)
        if len(over):
            near, who = self.near[over], self.who[over]
            first = np.argpartition(near, k - 1, axis=1)[:, :k]
            best, name = np.take_along_axis(near, first, 1), np.take_along_axis(who, first, 1)
            for r in np.flatnonzero((near <= best.max(1)[:, None]).sum(1) > k).tolist():
                order = np.lexsort((who[r], near[r]))[:k]
                best[r], name[r] = near[r, order], who[r, order]
            self.near[over, :k], self.who[over, :k], self.near[over, k:] = best, name, np.inf
            self.count[over] = k
        full = self.count >= k
        self.kth[full] = self.near[full, :k].max(1, initial=-np.inf)
        wide = k + k // 4 + SPARE
        if self.near.shape[1] > wide:
            self.near, self.who = self.near[:, :wide].copy(), self.who[:, :wide].copy()

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Distances and names, in order."""
        self.settle()
        near, who = self.near[:, : self.k], self.who[:, : self.k]
        order = np.lexsort((who, near), axis=1)
        return np.take_along_axis(near, order, 1), np.take_along_axis(who, order, 1)


def _last(near: np.ndarray, asked: int, density: float) -> tuple[np.ndarray, np.ndarray]:
    """The last place before the cut of running sums in rows of distances in order, as in kept(), and whether a row was long enough to tell, out of `asked` in all."""
    with np.errstate(invalid="ignore"):
        beta = near / density
        pos = np.arange(1.0, near.shape[1] + 1)
        s1, s2 = beta.cumsum(1), (beta * beta).cumsum(1)
        under = pos + s1 * s1 - pos * s2
        neg = np.where(under < 0, 0.0, (s1 + np.sqrt(np.maximum(under, 0.0))) / pos) - beta < 0
    neg &= np.isfinite(near)
    told = neg.any(1)
    return np.where(told, neg.argmax(1) - 1, asked - 1), told | (near.shape[1] >= asked) | ~np.isfinite(near[:, -1])


def _cells(cells: DataFrame, k: int, metric: str, same: bool, cut_of: tuple[int, float] | None = None) -> DataFrame:
    """id, nbr, pos, dist of the k nearest within each cell (cell, side, id, vec): rows of side 1 for each row of side 0.

    With `cut_of`, how many neighbours were asked for and a density, only those before the cut of running sums, `top`, the largest of their distances that are not zero, and whether they are the `last` of their id; a row whose k nearest do not reach its cut gives one row with pos 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, waiting, best = None, [], [], []

        def look() -> None:
            if waiting and held:
                if not best:
                    ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    best.extend(_Best(ids[i : i + BLOCK], x[i : i + BLOCK], k, metric, same) for i in range(0, len(ids), BLOCK))
                names, y = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
                for b in best:
                    b.see(names, y)
            waiting.clear()

        def out() -> Iterator[pa.RecordBatch]:
            look()
            while best:
                b = best.pop(0)
                near, who = b.rows()
                told = np.ones(len(near), bool)
                if cut_of and k:
                    last, told = _last(near, *cut_of)
                    near[np.arange(1, k + 1) > np.where(told, last, 1)[:, None]] = np.inf
                for i in range(0, len(near), 64):
                    some = np.isfinite(near[i : i + 64])
                    pos = np.where(told[i : i + 64, None], np.arange(1, k + 1, dtype=np.int32), np.int32(0))
                    columns = {"id": np.repeat(b.ids[i : i + 64], some.sum(1)), "nbr": who[i : i + 64][some], "pos": pos[some], "dist": near[i : i + 64][some]}
                    if cut_of:
                        columns["top"] = np.repeat(np.where(some & (near[i : i + 64] != 0), near[i : i + 64], -np.inf).max(1, initial=-np.inf), some.sum(1))
                        columns["last"] = (np.arange(1, k + 1) == some.sum(1)[:, None])[some]
                    yield pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            every_id = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                if cell[a] != at:
                    yield from out()
                    at, held = cell[a], []
                for i in range(a, b, TILE):
                    part = (every_id[i : min(b, i + TILE)], rows_of(batch.column(3).slice(i, min(b, i + TILE) - i)))
                    if side[a] == 0:
                        held.append(part)
                    else:
                        waiting.append(part)
                        if sum(len(w[0]) for w in waiting) >= TILE:
                            look()
        yield from out()

    return cells.mapInArrow(run, "id long, nbr long, pos int, dist double" + ", top double, last boolean" * bool(cut_of))


def _best(found: DataFrame, k: int) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("id").orderBy("dist", "nbr"))
    return found.withColumn("pos", pos).where(F.col("pos") <= k).select("id", "nbr", "pos", "dist")


def _dealt(m) -> Column:
    return F.pmod(F.xxhash64("id"), m if isinstance(m, Column) else F.lit(m)).cast("int")


def _every(m) -> Column:
    return F.explode(F.sequence(F.lit(0), (m if isinstance(m, Column) else F.lit(m)) - 1))


def neighbours(v: DataFrame, k: int, metric: str, others: DataFrame | None = None) -> DataFrame:
    """id, nbr, pos (from 1), dist: the k nearest other rows (id, vec) of each row, ties to the smaller id. With `others`, the nearest of those, of whichever id (a bipartite graph's)."""
    if metric not in METRICS:
        raise ValueError(f"the distance is one of {', '.join(METRICS)}")
    same = others is None
    n = v.count()
    blocks = max(1, math.ceil(n / _rows(k)))
    shares = max(1, math.ceil(2 * v.sparkSession.sparkContext.defaultParallelism / blocks))
    got = _cells(_grid(v, v if same else others, blocks, shares), k, metric, same)
    # With one share a row's nearest come from one cell, in order.
    return _best(got, k) if shares > 1 else got


def _rows(k: int) -> int:
    """Rows of a block, by the neighbours that each of them holds."""
    return max(BLOCK, min(ROWS, HELD // max(1, k)))


def _grid(v: DataFrame, others: DataFrame, blocks: int, shares: int, some: range | None = None) -> DataFrame:
    """cell, side, id, vec: a partition for each block of v (or only some of them) and share of the others."""
    some = some or range(blocks)
    rows = v.select(F.lit(0).alias("side"), _dealt(blocks).alias("block"), _every(shares).alias("share"), "id", "vec").where(F.col("block").between(some[0], some[-1]))
    past = others.select(F.lit(1).alias("side"), F.explode(F.sequence(F.lit(some[0]), F.lit(some[-1]))).alias("block"), _dealt(shares).alias("share"), "id", "vec")
    cells = rows.union(past).withColumn("cell", ((F.col("block") - some[0]) * shares + F.col("share")).cast("long"))
    return cells.repartitionById(len(some) * shares, F.col("cell").cast("int")).sortWithinPartitions("cell", "side").select("cell", "side", "id", "vec")


#: Rows by which kept_neighbours() guesses how long lists have to be.
GUESSED = 64


def kept_neighbours(v: DataFrame, k: int, metric: str, density: float = 1.0, others: DataFrame | None = None, tops: bool = False) -> DataFrame:
    """id, nbr, pos, dist: the same rows as kept(neighbours(v, k, metric, others), k, density). With `tops` also top, the largest distance of an id's rows that is not zero, and whether a row is the last of its id.

    A row is cut where its nearest are found, so that those beyond are not written. How many of the k most rows need is guessed from a few of them; rows that need more are looked at again with all k, so the guess changes no result.
    """
    if metric not in METRICS:
        raise ValueError(f"the distance is one of {', '.join(METRICS)}")
    same = others is None
    others = v if same else others
    wide = k
    cores = v.sparkSession.sparkContext.defaultParallelism
    if k > 128:
        asked = cut(v.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(GUESSED), "asked")
        lists = _best(_cells(_grid(asked, others, 1, 2 * cores), k, metric, same), k)
        lasts = [r[1] for r in kept(lists, k, density).groupBy("id").agg(F.max("pos")).collect()]
        need = math.ceil(1.25 * float(np.quantile(lasts, 0.9))) + 8 if lasts else k
        wide = need if need < k / 2 else k

    def look(rows: DataFrame, n: int, width: int) -> DataFrame:
        blocks = max(1, math.ceil(n / _rows(width)), min(2 * cores, math.ceil(n / 256)))
        # Each block has all others sent to it: a wave of blocks at a time, so that the disk holds the others a bounded number of times.
        found, wave = [], max(1, int(WAVE * cores))
        for at in range(0, blocks, wave):
            if at:
                drop_shuffles(v.sparkSession)
            found.append(cut(_cells(_grid(rows, others, blocks, 1, range(at, min(blocks, at + wave))), width, metric, same, (k, density)), "near"))
        return reduce(DataFrame.union, found)

    near = look(v, v.count(), wide)
    if wide < k and (short := (lacking := near.where("pos = 0").select("id")).count()):
        near = near.where("pos > 0").union(look(v.join(lacking, "id", "left_semi"), short, k))
    return near if tops else near.drop("top", "last")


def centres(v: DataFrame, count: int, sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Centres of k-means over a bounded sample: the rows of the least hashes of their ids."""
    rows = v.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = rows_of(rows.column("vec").combine_chunks())
    c = x[:count].copy()
    for _ in range(rounds):
        own = np.concatenate([tile(x[i : i + TILE], c, "l2")[0].argmin(1) for i in range(0, len(x), TILE)])
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _root_of(x: np.ndarray, metric: str) -> np.ndarray:
    """Where a row lies for cells: under jsd over the roots of its entries, where distances are alike."""
    return np.sqrt(np.maximum(x, 0)) if metric == "jsd" else x


def _cell_centres(v: DataFrame, n: int, metric: str, count: int | None) -> np.ndarray:
    laid = v.select("id", F.transform("vec", lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))).alias("vec")) if metric == "jsd" else v
    return centres(laid, count or max(1, min(4096, int(math.sqrt(n)))))


def _placed(v: DataFrame, c: np.ndarray, probes: int, metric: str) -> DataFrame:
    """id, vec, own (the cell of a row), near (the `probes` cells nearest to it), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TILE):
                part = batch.slice(i, TILE)
                d = tile(_root_of(rows_of(part.column(1)), metric), c, "l2")[0]
                some = np.argpartition(d, probes - 1, axis=1)[:, :probes] if probes < len(c) else np.broadcast_to(np.arange(len(c)), d.shape)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(d.argmin(1), pa.int32()), pa.array(some.tolist(), pa.list_(pa.int32()))], names=["id", "vec", "own", "near"])

    return cut(v.select("id", "vec").mapInArrow(run, "id long, vec array<double>, own int, near array<int>"), "placed")


def probes_for(v: DataFrame, c: np.ndarray, k: int, metric: str, recall: float, sample: int = 256) -> int:
    """The fewest cells to look into for a mean recall of `recall` at k, measured: the exact neighbours of the `sample` rows with the least hashes of their ids, among all rows, are counted by how near to the row their cells stand. As many counts as there are cells come back."""
    asked = cut(v.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(sample), "asked")
    real = neighbours(asked, k + 1, metric, v.select("id", "vec")).where("id <> nbr").where(F.col("pos") <= k + 1)
    real = real.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("dist", "nbr"))).where(F.col("pos") <= k)
    own = _placed(v, c, 1, metric).select(F.col("id").alias("nbr"), "own")
    found = real.join(own, "nbr").groupBy("id", "own").agg(F.count(F.lit(1)).alias("n")).join(asked, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(c), np.int64)
        for batch in batches:
            if batch.num_rows:
                d = tile(_root_of(rows_of(batch.column(2)), metric), c, "l2")[0]
                own = batch.column(0).to_numpy()
                np.add.at(counts, (d < d[np.arange(len(own)), own][:, None]).sum(1), batch.column(1).to_numpy())
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["rank", "n"])

    counts = np.zeros(len(c), np.int64)
    for rank, n in found.select("own", "n", "vec").mapInArrow(run, "rank int, n long").groupBy("rank").agg(F.sum("n")).collect():
        counts[rank] = n
    covered = counts.cumsum() / max(1, counts.sum())
    return int(np.searchsorted(covered, recall - 1e-12)) + 1


def approximate(v: DataFrame, k: int, metric: str, recall: float = 0.95, probes: int | None = None, count: int | None = None) -> DataFrame:
    """The same as neighbours(), from the `probes` cells nearest to each row of `count` (about the root of the number of rows) around centres; every row stands in one cell. As many are looked into as a mean recall of `recall` at this k takes (probes_for), unless `probes` is given.

    A cell with more rows than a block is looked at in a grid of blocks as a whole table is, so a common region is spread over tasks.
    """
    if metric not in METRICS:
        raise ValueError(f"the distance is one of {', '.join(METRICS)}")
    n = v.count()
    if n < 2:
        return neighbours(v, k, metric)
    c = _cell_centres(v, n, metric, count)
    probes = min(probes or probes_for(v, c, min(k, n - 1), metric, recall), len(c))
    placed = _placed(v, c, probes, metric)
    asking = placed.select(F.explode("near").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("asks"))
    holding = placed.groupBy(F.col("own").alias("list")).agg(F.count(F.lit(1)).alias("holds"))
    # As many numbers as there are centres.
    grid = asking.join(holding, "list").select("list", F.ceil(F.col("asks") / (4 * BLOCK)).cast("int").alias("blocks"), F.ceil(F.col("holds") / (4 * BLOCK)).cast("int").alias("shares"))
    ask = placed.select("id", "vec", F.explode("near").alias("list")).join(F.broadcast(grid), "list").select(F.lit(0).alias("side"), "list", _dealt(F.col("blocks")).alias("block"), _every(F.col("shares")).alias("share"), "id", "vec")
    hold = placed.select("id", "vec", F.col("own").alias("list")).join(F.broadcast(grid), "list").select(F.lit(1).alias("side"), "list", _every(F.col("blocks")).alias("block"), _dealt(F.col("shares")).alias("share"), "id", "vec")
    cells = ask.union(hold).withColumn("cell", F.col("list").cast("long") * (1 << 40) + F.col("block").cast("long") * (1 << 20) + F.col("share")).repartition("cell").sortWithinPartitions("cell", "side")
    return _best(_cells(cells.select("cell", "side", "id", "vec"), k, metric, True), k)


#: Members of one gathering of descend(): the rows around a row.
AROUND = 512


def _met(gathered: DataFrame, width: int, metric: str) -> DataFrame:
    """id, nbr, dist of the pairs of members of each gathering (cell, id, fresh, reach, vec), one of them fresh, that are nearer than the member's `reach`; the `width` nearest of each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        at = None

        def look() -> pa.RecordBatch | None:
            ids, fresh, reach = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2))
            ids, first = np.unique(ids, return_index=True)
            x, fresh, reach = np.concatenate([h[3] for h in held])[first], fresh[first], reach[first]
            d, error = tile(x, x, metric)
            d[~(fresh[:, None] | fresh[None, :])] = np.inf
            np.fill_diagonal(d, np.inf)
            d[d > reach[:, None] + error] = np.inf
            if len(ids) > width:
                far = np.argpartition(d, width, axis=1)[:, width:]
                np.put_along_axis(d, far, np.inf, 1)
            i, j = np.nonzero(np.isfinite(d))
            if not len(i):
                return None
            real = np.concatenate([exact(x[i[a : a + TILE]], x[j[a : a + TILE]], metric) for a in range(0, len(i), TILE)])
            return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(real)], names=["id", "nbr", "dist"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, ids, fresh, reach = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x = rows_of(batch.column(4))
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                if held and cell[a] != at:
                    if (got := look()) is not None:
                        yield got
                    held.clear()
                at = cell[a]
                held.append((ids[a:b], fresh[a:b], reach[a:b], x[a:b]))
        if held and (got := look()) is not None:
            yield got

    return gathered.select("cell", "id", "fresh", "reach", "vec").mapInArrow(run, "id long, nbr long, dist double")


def descend(v: DataFrame, k: int, metric: str, probes: int = 2, spare: int = 12, rounds: int = 12, least: float = 0.001) -> DataFrame:
    """The same as neighbours(), nearly: neighbour lists of k + `spare`, taken from the `probes` nearest cells at first, become better through the neighbours of neighbours, until a round changes a share of less than `least` of them.

    A round gathers around each row the members of its list and the rows that have it in theirs; all that meet there are compared if one of them is new to
    the list. Where more than `AROUND` rows have one in their lists, they are dealt over as many gatherings, the list's members being in each. It pays while the square of the list is below the number of rows that
    approximate() would compare: for a short list of a large table.
    """
    width = k + spare
    seeds = approximate(v, width, metric, probes=probes).select("id", "nbr", "dist", F.lit(True).alias("fresh"))
    now = cut(seeds, "lists")
    vectors = cut(v.select("id", "vec"), "vectors")
    n = vectors.count()
    by_id = Window.partitionBy("id").orderBy("dist", "nbr")
    for _ in range(rounds):
        hubs = broadcast_if_small(cut(now.groupBy(F.col("nbr").alias("at")).agg(F.ceil(F.count(F.lit(1)) / AROUND).cast("int").alias("parts")).where("parts > 1"), "hubs"))
        split = lambda df, member: df.hint("merge").join(hubs, "at", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).select("at", "member", "fresh", member.alias("part"))
        listed = split(now.select(F.col("id").alias("at"), F.col("nbr").alias("member"), "fresh"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        listing = split(now.select(F.col("nbr").alias("at"), F.col("id").alias("member"), "fresh"), F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
        # A row whose list is not full takes whatever it meets.
        reach = now.groupBy("id").agg(F.when(F.count(F.lit(1)) >= width, F.max("dist")).otherwise(float("inf")).alias("reach"))
        known = vectors.join(reach, "id", "left").select("id", "vec", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
        met = listed.union(listing).groupBy("at", "part", "member").agg(F.max("fresh").alias("fresh"))
        gathered = met.withColumnRenamed("member", "id").join(known, "id").withColumn("cell", F.xxhash64("at", "part")).repartition("cell").sortWithinPartitions("cell")
        new = _met(gathered, width, metric).withColumn("fresh", F.lit(True))
        both = now.withColumn("fresh", F.lit(False)).unionByName(new).groupBy("id", "nbr").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
        now = cut(both.withColumn("pos", F.row_number().over(by_id)).where(F.col("pos") <= width).select("id", "nbr", "dist", "fresh"), "lists", now)
        if now.where("fresh").count() < least * n * width:
            break
    return now.withColumn("pos", F.row_number().over(by_id)).where(F.col("pos") <= k).select("id", "nbr", "pos", "dist")


def found(v: DataFrame, k: int, metric: str, recall: float | None) -> DataFrame:
    """The exact neighbours, or, where the caller asks for a `recall`, those of approximate()."""
    return neighbours(v, k, metric) if recall is None else approximate(v, k, metric, recall)


def _similar(directed: DataFrame, metric: str) -> DataFrame:
    """Distances (src, dst, d) as weights: 1 (jsd) or the column's largest distance (`top`, if at hand), minus the distance, at least 1e-7. Zero distances are no edges."""
    some = directed.where("d <> 0")
    top = F.lit(1.0) if metric == "jsd" else F.col("top") if "top" in directed.columns else F.max("d").over(Window.partitionBy("dst"))
    return some.select("src", "dst", F.greatest(F.lit(1e-7), top - F.col("d")).alias("weight"))


def symmetric(g: DataFrame, mutual: bool) -> DataFrame:
    from matloom.operators.coo import symmetric as both

    return both(g, mutual)


def breadth(n: int) -> int:
    """How many neighbours the adaptive graph looks at."""
    return min(n - 1, 5 * int(math.floor(math.sqrt(n) + 0.5)))


def kept(near: DataFrame, k: int, density: float = 1.0) -> DataFrame:
    """Of the k nearest (id, nbr, pos, dist) of each row those before the cut of running sums, less the last."""
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    beta = F.col("dist") / F.lit(float(density))
    near = near.withColumn("b", beta).withColumn("s1", F.sum("b").over(w)).withColumn("s2", F.sum(F.col("b") * F.col("b")).over(w))
    under = F.col("pos") + F.col("s1") * F.col("s1") - F.col("pos") * F.col("s2")
    lam = F.when(under < 0, 0.0).otherwise((F.col("s1") + F.sqrt(F.greatest(under, F.lit(0.0)))) / F.col("pos"))
    near = near.withColumn("neg", lam - F.col("b") < 0)
    first: Column = F.min(F.when(F.col("neg"), F.col("pos"))).over(Window.partitionBy("id"))
    return near.withColumn("last", F.coalesce(first - 2, F.lit(k - 1))).where(F.col("pos") <= F.col("last"))


#: Rows whose last neighbours are sent to all tasks, 32 bytes each.
ENDS = 1_000_000


def _ends(near: DataFrame) -> list[np.ndarray] | None:
    """Ids in order, the distance and name of their last kept neighbour, and `top`; nothing for more than `ENDS` ids, or where an id has several lists."""
    last = near.where("last").select("id", "dist", "nbr", "top")
    if last.count() > ENDS:
        return None
    ends = [c.to_numpy() for c in last.toArrow().columns]
    order = np.argsort(ends[0], kind="stable")
    ends = [x[order] for x in ends]
    return None if (ends[0][1:] == ends[0][:-1]).any() else ends


def _both_ways(near: DataFrame, metric: str, ids: np.ndarray, dist: np.ndarray, name: np.ndarray, top: np.ndarray) -> DataFrame:
    """The mutual graph of exact kept neighbours. A distance is the same from both ends, so that a row is among its neighbour's if it comes no later than the last of these: no edge is shuffled."""
    held = near.sparkSession.sparkContext.broadcast((ids, dist, name, top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, dist, name, top = held.value
        for batch in batches:
            own, nbr, d, own_top = [batch.column(c).to_numpy() for c in range(4)]
            at = np.minimum(np.searchsorted(ids, nbr), max(len(ids) - 1, 0))
            some = np.flatnonzero((ids[at] == nbr) & ((d < dist[at]) | (d == dist[at]) & (own <= name[at]))) if len(ids) else np.zeros(0, int)
            own, nbr, d, at = own[some], nbr[some], d[some], at[some]
            one, other = (1.0, 1.0) if metric == "jsd" else (own_top[some], top[at])
            w = np.sqrt(np.maximum(1e-7, one - d) * np.maximum(1e-7, other - d))
            yield pa.RecordBatch.from_arrays([pa.array(nbr), pa.array(own), pa.array(w)], names=["src", "dst", "weight"])

    return near.where("dist <> 0").select("id", "nbr", "dist", "top").mapInArrow(run, "src long, dst long, weight double")


def adaptive(v: DataFrame, metric: str = "jsd", density: float = 1.0, mutual: bool = True, directed: bool = False, recall: float | None = None) -> DataFrame:
    """The k*-nearest-neighbour graph (src, dst, weight): every node keeps as many of its nearest as the cut of running sums allows, less the last. Neighbours are exact, or approximate() ones of a mean `recall`."""
    k = breadth(v.count())
    near = kept_neighbours(v, k, metric, density, tops=True) if recall is None else kept(approximate(v, k, metric, recall), k, density)
    if mutual and not directed and recall is None and (ends := _ends(near)) is not None:
        return _both_ways(near, metric, *ends)
    g = _similar(near.select(F.col("nbr").alias("src"), F.col("id").alias("dst"), F.col("dist").alias("d"), *(["top"] if "top" in near.columns else [])), metric)
    return g if directed else symmetric(g, mutual)


def bipartite(v: DataFrame, others: DataFrame, metric: str = "jsd", density: float = 1.0) -> DataFrame:
    """The k*-nearest rows of `others` for each row of v, by the same cut: src (of others), dst (of v), weight."""
    m = others.count()
    k = min(m, 5 * int(math.floor(math.sqrt(m) + 0.5)))
    return _similar(kept_neighbours(v, k, metric, density, others, tops=True).select(F.col("nbr").alias("src"), F.col("id").alias("dst"), F.col("dist").alias("d"), "top"), metric)


def fixed(v: DataFrame, k: int = 10, metric: str = "jsd", mutual: bool = True, farthest: bool = False, directed: bool = False, recall: float | None = None) -> DataFrame:
    """The graph of the k nearest, of which a node itself is one. `farthest` keeps only the farther half of them. Neighbours are exact, or approximate() ones of a mean `recall`."""
    near = found(v, k - 1, metric, recall)
    if farthest:
        near = near.where(F.col("pos") + 1 > k - math.ceil(k / 2))
    g = _similar(near.select(F.col("id").alias("src"), F.col("nbr").alias("dst"), F.col("dist").alias("d")), metric)
    return g if directed else symmetric(g, mutual)


def build(v: DataFrame, algorithm: str = "k*nn", metric: str = "jsd", density: float = 1.0, mutual: bool = True, k: int = 10, recall: float | None = None) -> DataFrame:
    if algorithm == "k*nn":
        return adaptive(v, metric, density, mutual, recall=recall)
    if algorithm == "knn":
        return fixed(v, k, metric, mutual, recall=recall)
    raise ValueError("the algorithm is k*nn or knn")
