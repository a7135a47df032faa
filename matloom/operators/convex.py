"""Convex combinations of the rows of a table that no task holds whole: projection-free regression, archetypes by passes, coresets, and archetypes of a stream.

A row (id, vec) is an observation; its length is modest, its number is not. What comes to the driver are rows that become atoms (a few a target and pass), sums of
features x archetypes, and no observations otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matloom.operators.dense import rows_of
from matloom.operators.linalg import sum_of
from matloom.operators.simplex import regression, solve, solve_many
from matloom.plans.materialize import cut


@dataclass
class Atoms:
    """A convex combination: ids, their vectors (features x atoms) and weights; `gap` bounds how far half the squared distance is from the least."""

    ids: list[int]
    x: np.ndarray
    weights: np.ndarray
    gap: float = np.inf
    passes: int = field(default=0)

    def point(self) -> np.ndarray:
        return self.x @ self.weights


def _least(v: DataFrame, slopes: np.ndarray, own: float, several: int = 1) -> list[list[tuple[int, np.ndarray]]]:
    """For each column of `slopes` the `several` rows (id, vec) with the least products with it (plus `own` times the row's square), in order; ties go to the smaller id. One pass; each task sends as many rows a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in range(slopes.shape[1])]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), rows_of(batch.column(1))
            score = x @ slopes
            if own:
                score += own * (x * x).sum(1)[:, None]
            for t, held in enumerate(best):
                for i in np.lexsort((ids, score[:, t]))[:several]:
                    held.append((float(score[i, t]), int(ids[i]), x[i].tolist()))
                held.sort(key=lambda r: r[:2])
                del held[several:]
        rows = [(t, *b) for t, held in enumerate(best) for b in held]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())))], names=["target", "score", "id", "vec"])

    rows = v.select("id", "vec").mapInArrow(run, "target int, score double, id long, vec array<double>")
    found = rows.groupBy("target").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "id", "vec"))), 1, several).alias("b")).collect()
    if not found:
        raise ValueError("there are no rows to combine")
    got = {r["target"]: [(b["id"], np.array(b["vec"])) for b in r["b"]] for r in found}
    return [got[t] for t in range(slopes.shape[1])]


def _corrected(atoms: Atoms, b: np.ndarray, tol: float, steps: int = 300) -> None:
    """Moves weights among the atoms, towards the best one or away from the worst, until the gap among them is below `tol`, or, after `steps` of them, to where an active set ends; atoms without weight are given up."""
    g, c, w = atoms.x.T @ atoms.x, atoms.x.T @ b, atoms.weights
    for _ in range(steps):
        slope = g @ w - c
        level = slope @ w
        low = int(np.argmin(slope))
        held = np.flatnonzero(w > 0)
        high = int(held[np.argmax(slope[held])])
        toward, away = level - slope[low], slope[high] - level
        if max(toward, away) <= tol:
            break
        if toward >= away:
            d, most = -w, 1.0
            d[low] += 1
        else:
            d, most = w.copy(), w[high] / max(1 - w[high], 1e-300)
            d[high] -= 1
        bend = d @ g @ d
        step = min(most, max(toward, away) / bend) if bend > 0 else most
        w = w + step * d
        if step == most and toward < away:
            w[high] = 0.0
        w = np.maximum(w, 0)
        w /= w.sum()
    else:
        exact = solve(atoms.x, b, gram=g)
        if ((atoms.x @ exact - b) ** 2).sum() <= ((atoms.x @ w - b) ** 2).sum():
            w = exact
    keep = w > 0
    atoms.ids, atoms.x, atoms.weights = [i for i, k in zip(atoms.ids, keep) if k], atoms.x[:, keep], w[keep] / w[keep].sum()


def frank_wolfe(v: DataFrame, targets: np.ndarray, tol: float = 1e-8, passes: int = 200, start: list[Atoms | None] | None = None, several: int = 4) -> list[Atoms]:
    """For each column of `targets` (features x few) the convex combination of rows (id, vec) nearest to it.

    A pass looks, for all targets at once, for the row that the slope of the squared distance points to; it becomes an atom, with the next best ones, `several` in all, and weights are moved among the
    atoms with steps towards and away. A target is done when its duality gap is below `tol` times the square of its length, or of its atoms' longest where that is more. No row is gathered but the atoms.
    """
    targets = np.asarray(targets, float)
    out: list[Atoms] = list(start) if start else [None] * targets.shape[1]
    new = [t for t, a in enumerate(out) if a is None]
    if new:
        for t, [(i, x)] in zip(new, _least(v, -targets[:, new], 0.5)):
            out[t] = Atoms([i], x[:, None], np.ones(1))
    size = lambda t: max((targets[:, t] ** 2).sum(), (out[t].x ** 2).sum(0).max(), 1e-300)
    if start:
        for t, a in enumerate(out):
            _corrected(a, targets[:, t], 0.1 * tol * size(t))
    open_ = list(range(targets.shape[1]))
    for _ in range(passes):
        slopes = np.stack([out[t].point() - targets[:, t] for t in open_], 1)
        found = _least(v, slopes, 0.0, several)
        rest = []
        for t, s, near in zip(open_, slopes.T, found):
            a = out[t]
            a.passes += 1
            level = float(s @ a.point())
            a.gap = level - float(s @ near[0][1])
            if a.gap > tol * size(t):
                rest.append(t)
                for i, x in near:
                    if i not in a.ids and s @ x < level:
                        a.ids, a.x, a.weights = [*a.ids, i], np.concatenate([a.x, x[:, None]], 1), np.append(a.weights, 0.0)
                _corrected(a, targets[:, t], 0.1 * tol * size(t))
        open_ = rest
        if not open_:
            break
    return out


@dataclass
class Fit:
    """Archetypes w (features x k), the combination of rows that each is, and the weighted squared residual."""

    w: np.ndarray
    atoms: list[Atoms]
    residual: float
    rounds: int

    def weights(self, v: DataFrame) -> DataFrame:
        """id, vec: every row's weights on the archetypes."""
        return regression(v, self.w)

    def combinations(self, spark: SparkSession) -> DataFrame:
        """id, arch, c: the rows that the archetypes are made of."""
        return spark.createDataFrame([(i, k, float(c)) for k, a in enumerate(self.atoms) for i, c in zip(a.ids, a.weights)], "id long, arch int, c double")


def _moments(v: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """X H (features x k), HᵀH and the squares of X, weighted, with H the best weights on w: one pass."""
    m, k = w.shape
    g = w.T @ w

    def work(x: np.ndarray, own: np.ndarray) -> np.ndarray:
        h = solve_many(w, x, gram=g)
        return np.concatenate([(x.T @ (own * h)).ravel(), (h.T @ (own * h)).ravel(), [(own[:, 0] * (x * x).sum(1)).sum()]])

    own = F.col("weight") if "weight" in v.columns else F.lit(1.0)
    got = sum_of(v.select("vec", F.array(own.cast("double"))), work, m * k + k * k + 1)
    return got[: m * k].reshape(m, k), got[m * k : -1].reshape(k, k), float(got[-1])


def _residual(w: np.ndarray, xh: np.ndarray, hh: np.ndarray, square: float) -> float:
    return max(0.0, square - 2 * (w * xh).sum() + (w.T @ w * hh).sum())


def archetypes(v: DataFrame, w: np.ndarray, rounds: int = 100, tol: float = 1e-6, gap: float = 1e-8) -> Fit:
    """Archetypal analysis of rows (id, vec, and a `weight` each, as a coreset has) from archetypes w (features x k), as simplex.aa does it for a matrix at hand.

    A round is one pass for the sums that all weights enter, and a few more for each archetype's combination, which starts from the atoms of the round before.
    """
    w, k = np.array(w, float), w.shape[1]
    atoms: list[Atoms | None] = [None] * k
    last, done = np.inf, 0
    xh, hh, square = _moments(v, w)
    for done in range(1, rounds + 1):
        for i in range(k):
            size = hh[i, i]
            if size < 1e-7:
                j, x = _farthest(v, w)
                atoms[i] = Atoms([j], x[:, None], np.ones(1), 0.0)
            else:
                target = w[:, i] + (xh[:, i] - w @ hh[:, i]) / size
                atoms[i] = frank_wolfe(v, target[:, None], gap, start=[atoms[i]] if atoms[i] is not None else None)[0]
            w[:, i] = atoms[i].point()
        # The weights are the old ones' here, as they are where simplex.aa compares residuals.
        now = np.sqrt(_residual(w, xh, hh, square))
        xh, hh, square = _moments(v, w)
        if abs(last - now) / max(last if np.isfinite(last) else now, 1e-300) < tol:
            break
        last = now
    return Fit(w, atoms, _residual(w, xh, hh, square), done)


def _farthest(v: DataFrame, w: np.ndarray) -> tuple[int, np.ndarray]:
    """The row with the largest residual; ties go to the smaller id."""
    g = w.T @ w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column(1))
                r = ((x - solve_many(w, x, gram=g) @ w.T) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(-r), batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.list_(pa.float64()))], names=["score", "id", "vec"])

    b = v.select("id", "vec").mapInArrow(run, "score double, id long, vec array<double>").agg(F.min(F.struct("score", "id", "vec")).alias("b")).first()["b"]
    return b["id"], np.array(b["vec"])


def coreset(v: DataFrame, size: int, even: float = 0.5, seed: int = 0) -> DataFrame:
    """id, vec, weight: `size` rows drawn without replacement, and what each stands for.

    A row is drawn with a probability p of which the share `even` is the same for all, and the rest goes by its squared distance from the mean. It draws a number u by a hash of its id, and the rows with the least
    -ln(u) / p are taken; their weights are 1 / (size p). `size` is what a coreset is for: the sample comes from one sort of numbers, whatever the number of rows.
    """
    n, width = v.count(), len(v.select("vec").first()[0])
    mean = sum_of(v.select("vec"), lambda x: x.sum(0), width) / n
    far = F.aggregate(F.arrays_zip(F.col("vec"), F.array(*[F.lit(float(x)) for x in mean]).alias("mean")), F.lit(0.0), lambda a, z: a + (z["vec"] - z["mean"]) ** 2)
    rows = v.select("id", "vec", far.alias("far"))
    whole = rows.agg(F.sum("far")).first()[0]
    share = F.lit(even / n) + (F.lit((1 - even) / whole) * F.col("far") if whole > 0 else F.lit((1 - even) / n))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    drawn = rows.withColumn("p", share).withColumn("key", F.when(F.col("p") > 0, -F.log(u) / F.col("p")).otherwise(F.lit(float("inf"))))
    return drawn.orderBy("key", "id").limit(size).select("id", "vec", (1.0 / (F.lit(float(min(size, n))) * F.col("p"))).alias("weight"))


@dataclass
class Online:
    """Archetypes of a stream: w (features x k), and the sums of the weights' products (k x k) and of rows times weights (features x k) so far."""

    w: np.ndarray
    a: np.ndarray
    b: np.ndarray

    @classmethod
    def start(cls, w: np.ndarray) -> Online:
        w = np.array(w, float)
        w /= np.maximum(np.linalg.norm(w, axis=0), 1e-300)
        return cls(w, np.zeros((w.shape[1],) * 2), np.zeros(w.shape))

    def seen(self, v: DataFrame) -> Online:
        """After the rows (id, vec) of one batch, each made to have length one: one pass for their sums, then one step for each archetype in turn."""
        square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
        unit = v.select("id", "vec").withColumn("s", square).where("s > 0").select("id", F.transform("vec", lambda x: x / F.sqrt(F.col("s"))).alias("vec"))
        xh, hh, _ = _moments(unit, self.w)
        a, b, w = self.a + hh, self.b + xh, self.w.copy()
        for j in range(w.shape[1]):
            if a[j, j] > 0:
                u = w[:, j] + (b[:, j] - w @ a[:, j]) / a[j, j]
                w[:, j] = u / max(np.linalg.norm(u), 1.0)
        return Online(w, a, b)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(kind, i, j, float(x)) for kind in "wab" for (i, j), x in np.ndenumerate(getattr(self, kind))]
        spark.createDataFrame(rows, "kind string, i int, j int, value double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Online:
        parts: dict[str, dict] = {k: {} for k in "wab"}
        for kind, i, j, x in spark.read.parquet(path).collect():
            parts[kind][i, j] = x
        out = {}
        for kind, cells in parts.items():
            m = np.zeros((1 + max(i for i, _ in cells), 1 + max(j for _, j in cells)))
            for at, x in cells.items():
                m[at] = x
            out[kind] = m
        return cls(**out)


def online(stream: DataFrame, w: np.ndarray, path: str) -> StreamingQuery:
    """Runs through what a stream (id, vec) has, a batch at a time, and ends; the model after batch n stands in path/model/n, beside the stream's checkpoint in path/checkpoint.

    A batch that is run again after a stop starts from the model of the batch before it, so it gives the same model. Called again, it goes on with what is new.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        model = Online.start(w) if n == 0 else Online.load(spark, f"{path}/model/{n - 1}")
        (model.seen(cut(batch.select("id", "vec"), "batch")) if not batch.isEmpty() else model).save(spark, f"{path}/model/{n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
