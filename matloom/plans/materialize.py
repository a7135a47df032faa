"""Cutting lineage through storage that every executor can read."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group, which each task that writes holds in memory.
ROW_GROUP = 16 << 20
#: Files of a table for each core, at most. Without Hadoop's native library the local file system starts processes (chmod) for every file and
#: task folder, and each counts as a second JVM until it has become the other program.
FILES = 4
_WRITTEN: list[tuple[SparkSession, str]] = []
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one below the warehouse, or a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="matloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_matloom"
    return _LOCAL[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/matloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def cut(df: DataFrame, name: str = "cut", instead_of: DataFrame | None = None) -> DataFrame:
    """Writes `df` as a Parquet table in the shared folder and reads it back, so that later plans start from files.

    `instead_of`: a result of cut() that this one takes the place of, as a round does of the round before; its table is removed. No other DataFrame may still read it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    # Nothing looks for the marker of success, a file that the driver would write.
    few = df.coalesce(FILES * spark.sparkContext.defaultParallelism)
    few.write.option("parquet.block.size", ROW_GROUP).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._written = path
    if (old := getattr(instead_of, "_written", None)) is not None:
        _WRITTEN.remove((spark, old))
        _remove(spark, old)
    return got


def drop_shuffles(spark: SparkSession) -> None:
    """Has the files of shuffles removed that no DataFrame needs any more, which Spark does once the driver's JVM has found them unreachable."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Removes what cut() has written; call it once no DataFrame built on it is needed."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            _remove(spark, path)
        except Exception:  # the session may have ended
            return


atexit.register(release)
