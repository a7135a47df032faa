"""Reading tables, and letting Python workers find this package."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def let_workers_import(spark: SparkSession) -> None:
    """Prepares the session. Workers look for modules where the driver has found this package (on a cluster it is shipped with --py-files)."""
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, HOME])
    # Workers serve one stage after the other: what one has freed is to be free for the next.
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "2")
    # Texts differ in length a thousandfold: batches of fewer rows and bytes bound what a worker holds. A session's own setting stands.
    for key, usual, own in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", None, "8m")):
        if spark.conf.get(key) == usual or usual is None:
            spark.conf.set(key, own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
