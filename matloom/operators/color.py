"""CIE L*a*b* (D65) to sRGB in column expressions, and node colours from coordinates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matloom.operators.coo import zscore
from matloom.operators.dense import gram
from matloom.operators.linalg import oriented

#: The white point, the matrix from XYZ to linear sRGB, the knee of the Lab curve; below, the numbers of the sRGB gamma.
WHITE = (0.950456, 1.0, 1.088754)
TO_RGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
KNEE = 0.206896551724137931


def _linear(t: Column) -> Column:
    return F.when(t >= KNEE, t * t * t).otherwise((t - 16.0 / 116.0) * (108.0 / 841.0))


def _gamma(x: Column) -> Column:
    return F.when(x <= 0.0031306684425005883, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def rgb(x: DataFrame) -> DataFrame:
    """`x` (l, a, b and others) with r, g, b in [0, 1] in their place. Negative channels are lifted together before the gamma."""
    y = (F.col("l") + 16) / 116
    xyz = x.withColumn("_y", y).withColumn("_x", _linear(F.col("_y") + F.col("a") / 500) * WHITE[0]).withColumn("_z", _linear(F.col("_y") - F.col("b") / 200) * WHITE[2]).withColumn("_y", _linear(F.col("_y")) * WHITE[1])
    for name, m in zip(("_r", "_g", "_b"), TO_RGB):
        xyz = xyz.withColumn(name, m[0] * F.col("_x") + m[1] * F.col("_y") + m[2] * F.col("_z"))
    xyz = xyz.withColumn("_low", F.least(F.lit(0.0), "_r", "_g", "_b"))
    keep = [c for c in x.columns if c not in ("l", "a", "b")]
    return xyz.select(*keep, *[F.least(F.lit(1.0), F.greatest(F.lit(0.0), _gamma(F.col(f"_{c}") - F.col("_low")))).alias(c) for c in ("r", "g", "b")])


def rgb_sql(source: str) -> str:
    """Common table expressions ending in `rgb`, from a table (id, l, a, b)."""
    f = lambda t: f"CASE WHEN {t} >= {KNEE!r} THEN ({t}) * ({t}) * ({t}) ELSE (({t}) - 16.0 / 116.0) * (108.0 / 841.0) END"
    lin = ", ".join(f"{m[0]} * x + {m[1]} * y + {m[2]} * z AS {n}" for n, m in zip(("r1", "g1", "b1"), TO_RGB))
    gam = lambda t: f"least(1, greatest(0, CASE WHEN {t} <= 0.0031306684425005883 THEN 12.92 * ({t}) ELSE 1.055 * pow({t}, 1 / 2.4) - 0.055 END))"
    return (
        f"xyz AS (SELECT id, {WHITE[0]} * ({f('(l + 16) / 116 + a / 500')}) AS x, {f('(l + 16) / 116')} AS y, {WHITE[2]} * ({f('(l + 16) / 116 - b / 200')}) AS z FROM {source}), li AS (SELECT id, {lin} FROM xyz), lo AS (SELECT *, least(0, r1, g1, b1) AS low FROM li), "
        f"rgb AS (SELECT id, {gam('r1 - low')} AS r, {gam('g1 - low')} AS g, {gam('b1 - low')} AS b FROM lo)"
    )


def node_colors(x: DataFrame) -> DataFrame:
    """id, r, g, b from coordinates (id, vec) of three or more components: the first three left singular vectors, standardised, as a, b and lightness."""
    g = gram(x)
    if len(g.total) < 3:
        raise ValueError("three coordinates are needed")
    values, right = np.linalg.eigh(g.products)
    order = np.argsort(values)[::-1][:3]
    basis = oriented(right[:, order]) / np.sqrt(np.maximum(values[order], 1e-300))
    parts = F.array(*[F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(c)) for c in basis[:, k]]), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v) for k in range(3)])
    z = zscore(x.select("id", F.posexplode(parts).alias("dim", "value")))
    wide = z.groupBy("id").agg(*[F.max(F.when(F.col("dim") == k, F.col("value"))).alias(f"z{k}") for k in range(3)])
    low, high = wide.agg(F.min("z2"), F.max("z2")).first()
    lab = wide.select("id", (25 + 70 * (F.col("z2") - low) / F.lit((high - low) or 1.0)).alias("l"), (75 * F.col("z0")).alias("a"), (75 * F.col("z1")).alias("b"))
    return rgb(lab)
