"""Registration of queries with their SQL, and the driver tables as matrices."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.operators.lineage import checkpoint_folder
from veldt.operators.matrix import Matrix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WIDTH = 64
E_SQL = "e AS (SELECT vec_id AS i, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
L_SQL = "l AS (SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"
O_SQL = "o AS (SELECT o_custkey AS i, CAST(ascii(o_orderpriority) - 49 AS BIGINT) AS j, sum(o_totalprice) AS v FROM orders GROUP BY ALL)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only for a local master."""
    return f"{checkpoint_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}/{name}"


def r6(c):
    """Six places, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def embeddings(spark: SparkSession, sf: str) -> Matrix:
    """Vectors x 64; ids are row indexes (the extent is not counted: rows are never dense)."""
    return Matrix.from_arrays(table(spark, sf, "embeddings"), "vec_id", "embedding", 1 << 40, WIDTH)


def lineitems(spark: SparkSession, sf: str) -> Matrix:
    """Orders x parts by quantity, duplicates summed."""
    df = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    return Matrix.from_triplets(df, 1 << 40, 1 << 40)


def orders(spark: SparkSession, sf: str) -> Matrix:
    """Customers x priorities (5) by total price."""
    df = table(spark, sf, "orders").select(F.col("o_custkey").alias("i"), (F.ascii("o_orderpriority") - 49).cast("long").alias("j"), F.col("o_totalprice").alias("v"))
    return Matrix.from_triplets(df, 1 << 40, 5)


def rounded(m: Matrix) -> DataFrame:
    return m.df.select("i", "j", r6(F.col("v")).alias("v"))
