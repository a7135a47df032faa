"""Non-negative factors of a table of observations (id, vec): from a decomposition's signs, and one after the other from below.

Rows keep what belongs to an observation; of the features' side a few vectors stand on the driver, each the sum of one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matloom.operators.dense import rows_of
from matloom.operators.linalg import sum_of, svd
from matloom.plans.materialize import cut


@dataclass
class Factors:
    """Features x k here, observations (id, vec of k) as a table; `weights` and `rest` (the share of squares left after each factor) where the method gives them."""

    features: np.ndarray
    observations: DataFrame
    weights: np.ndarray | None = None
    rest: np.ndarray | None = None


def _mapped(v: DataFrame, f) -> DataFrame:
    """id, vec with f of a batch's matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(f(rows_of(batch.column(1))).tolist(), pa.list_(pa.float64()))], names=["id", "vec"])

    return v.select("id", "vec").mapInArrow(run, "id long, vec array<double>")


def nndsvd(v: DataFrame, k: int, algorithm: str = "irlb", seed: int = 0) -> Factors:
    """Of each singular pair the positive or the negative parts, whichever weigh more together, scaled so that their product is the part's share of the pair."""
    got = svd(v, k, algorithm, seed=seed)
    right = cut(got.right(v), "right")
    k = len(got.values)
    squares = sum_of(right.select("vec"), lambda x: np.concatenate([(np.maximum(x, 0) ** 2).sum(0), (np.minimum(x, 0) ** 2).sum(0)]), 2 * k)
    parts = np.stack([np.maximum(got.left, 0), np.maximum(-got.left, 0)])
    of_left, of_right = np.linalg.norm(parts, axis=1), np.sqrt(squares.reshape(2, k))
    both = of_left * of_right
    side = (both[1] > both[0]).astype(int)
    each = np.arange(k)
    scale = np.sqrt(got.values * both[side, each])
    safe = lambda x: np.where(x > 0, x, 1.0)
    left = parts[side, :, each].T * scale / safe(of_left[side, each])
    sign, turn = np.where(side, -1.0, 1.0), scale / safe(of_right[side, each])
    return Factors(left, _mapped(right, lambda x: np.maximum(x * sign, 0) * turn), got.values)


def _under(state: DataFrame, x: np.ndarray, step: int, halve: bool = False) -> DataFrame:
    """id, m, over, y after one round: y from x on m - over, and the multipliers moved against what is left; with `halve` y stays and they are halved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, over, y = rows_of(batch.column(1)), rows_of(batch.column(2)), batch.column(3).to_numpy()
            if halve:
                over = over / 2
            else:
                y = np.maximum((m - over) @ x, 0) / (x @ x)
                over = np.maximum(over - (m - np.outer(y, x)) / step, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(over.tolist(), pa.list_(pa.float64())), pa.array(y)], names=["id", "m", "over", "y"])

    return state.mapInArrow(run, "id long, m array<double>, over array<double>, y double")


def underapproximations(v: DataFrame, k: int, rounds: int = 20, strict: bool = False) -> Factors:
    """k rank-one factors, one after the other, each below what is left of a non-negative table as far as its multipliers make it so: a singular pair, then rounds that move x, y and the multipliers of m >= x y in turn. What a factor leaves below zero becomes zero.

    Factors sum up to one on both sides, with their weight beside. `strict`: a row's share of a factor is lowered to where the factor is nowhere above what is left, so that the sum of all factors is below the table. A round is two passes, the second over a written table.
    """
    left = cut(v.select("id", "vec"), "left")
    width = len(left.select("vec").first()[0])
    whole = sum_of(left.select("vec"), lambda m: np.array([(m * m).sum()]), 1)[0]
    xs, weights, rest = [], [], []
    shares: DataFrame | None = None
    for _ in range(min(k, width)):
        pair = svd(left, 1)
        x = np.abs(pair.left[:, 0]) * np.sqrt(pair.values[0])
        first = left.join(pair.right(left).select("id", F.abs(F.col("vec")[0] * float(np.sqrt(pair.values[0]))).alias("y")), "id")
        start = F.transform(F.arrays_zip("vec", F.array(*map(F.lit, x.tolist())).alias("x")), lambda z: F.greatest(F.lit(0.0), F.col("y") * z["x"] - z["vec"]))
        state = cut(first.select("id", F.col("vec").alias("m"), start.alias("over"), "y"), "under")
        for j in range(rounds):
            new = np.maximum(sum_of(state.select("m", "over", F.array("y")), lambda m, over, y: (m - over).T @ y[:, 0], width), 0)
            new /= new.max() + 1e-16
            moved = cut(_under(state, new, j + 1), "under") if new.sum() else None
            if moved is not None and (moved.agg(F.sum("y")).first()[0] or 0.0) > 0:
                x = new
            else:
                moved = cut(_under(state, x, j + 1, halve=True), "under")
            state = moved
        y = state.select("id", "y", "m")
        if strict:
            positive = F.transform(F.arrays_zip("m", F.array(*map(F.lit, x.tolist())).alias("x")), lambda z: F.when(z["x"] > 0, z["m"] / z["x"]))
            y = y.select("id", F.least("y", F.coalesce(F.array_min(positive), F.lit(0.0))).alias("y"), "m")
        y = cut(y, "shares")
        total = y.agg(F.sum("y")).first()[0] or 0.0
        left = cut(y.select("id", F.transform(F.arrays_zip("m", F.array(*map(F.lit, x.tolist())).alias("x")), lambda z: F.greatest(F.lit(0.0), z["m"] - F.col("y") * z["x"])).alias("vec")), "left")
        rest.append(sum_of(left.select("vec"), lambda m: np.array([(m * m).sum()]), 1)[0] / whole if whole else 0.0)
        xs.append(x / (x.sum() or 1.0))
        weights.append(x.sum() * total)
        one = y.select("id", (F.col("y") / (total or 1.0)).alias("y"))
        shares = one.select("id", F.array("y").alias("vec")) if shares is None else cut(shares.join(one, "id").select("id", F.concat("vec", F.array("y")).alias("vec")), "shares")
    return Factors(np.stack(xs, 1), shares, np.array(weights), np.array(rest))
