"""Ranks and running sums over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matloom.plans.materialize import cut


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """`df` with, for each (column, name) of `sums`, the sum of the column over the rows before, in `order`, which must be unique.

    Rows are range-partitioned and written once, so that partitions keep their places; each sums its own rows, and
    one small window over the partitions' totals gives their offsets.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{n}") for c, n in sums.items()])
    offsets = totals.select("_part", *[zero(F.sum(f"_s_{n}").over(before)).alias(f"_o_{n}") for n in sums.values()])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    got = placed.select("*", *[zero(F.sum(c).over(own)).alias(n) for c, n in sums.items()]).join(F.broadcast(offsets), "_part")
    return got.select(*[c for c in placed.columns if c != "_part"], *[(F.col(n) + F.col(f"_o_{n}")).alias(n) for n in sums.values()])
