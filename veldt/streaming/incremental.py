"""Incremental operators for Structured Streaming: triplet merges and running Gram matrices.

Both are stateful aggregates of the stream itself, so Spark keeps, checkpoints and recovers
their state; `merge_into` is a foreachBatch sink that is idempotent by batch number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def triplet_sums(stream: DataFrame) -> DataFrame:
    """Running sums of (i, j, v): use with output mode update or complete."""
    return stream.groupBy("i", "j").agg(F.sum("v").alias("v"))


def gram(stream: DataFrame, array_column: str) -> DataFrame:
    """The running A^T A of row arrays, lower half, as (i, j, v)."""
    rows = stream.select(F.posexplode(array_column).alias("i", "x"), F.col(array_column).alias("_row"))
    pairs = rows.select("i", "x", F.posexplode("_row").alias("j", "y")).where("i >= j")
    return pairs.groupBy("i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("v"))


def merge_into(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch's summed triplets become one folder, written over if the batch is repeated."""

    def run(batch: DataFrame, number: int) -> None:
        batch.groupBy("i", "j").agg(F.sum("v").alias("v")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def merged(spark, path: str) -> DataFrame:
    """The matrix that all batches add up to."""
    return spark.read.parquet(path).groupBy("i", "j").agg(F.sum("v").alias("v"))
