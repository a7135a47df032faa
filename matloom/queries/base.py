"""Tables as matrices and graphs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Columns rounded to six places; a negative zero becomes zero."""
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c), 6) + F.lit(0.0))
    return df


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Part x supplier: quantities."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("row_id"), F.col("l_suppkey").alias("col_id")).agg(F.sum("l_quantity").alias("value"))


def part_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"))


def supplier_vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"))


def brands(spark: SparkSession, d: str) -> DataFrame:
    """Part x brand: ones. The brand's number is what follows '#'."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("long").alias("col_id"), F.lit(1.0).alias("value"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def simplex(spark: SparkSession, d: str) -> DataFrame:
    """Positive parts of the vectors, made to sum to one."""
    up = F.transform("vec", lambda x: F.greatest(x, F.lit(0.0)))
    v = vectors(spark, d).select("id", up.alias("vec")).withColumn("s", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x))
    return v.select("id", F.transform("vec", lambda x: x / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("vec"))


def long(v: DataFrame) -> DataFrame:
    return v.select("id", F.posexplode("vec").alias("dim", "value"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")


#: The same in SQL, as common table expressions.
S = "s AS (SELECT l_partkey AS row_id, l_suppkey AS col_id, sum(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY ALL)"
V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
E = V + ", e AS (SELECT id, unnest(vec) AS value, (generate_subscripts(vec, 1) - 1)::INT AS dim FROM v)"
H = (
    V
    + ", h0 AS (SELECT id, list_transform(vec, lambda x: greatest(x, 0.0)) AS vec FROM v)"
    + ", h AS MATERIALIZED (SELECT id, list_transform(vec, lambda x: x / CASE WHEN list_sum(vec) = 0 THEN 1.0 ELSE list_sum(vec) END) AS vec FROM h0)"
)
X = "x AS (SELECT p_partkey AS row_id, regexp_extract(p_brand, '([0-9]+)$', 1)::BIGINT AS col_id, 1.0::DOUBLE AS value FROM part)"
