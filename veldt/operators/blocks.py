"""Block-sparse matrices: (bi, bj, block) with dense size x size blocks as row-major array cells; a missing block is zero.

Blocks are multiplied in Arrow batches by one NumPy product each batch, sums of products
are combined there first; everything else is Column arithmetic on array cells.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.operators import sparse_direct
from veldt.operators.matrix import Matrix

SCHEMA = "bi long, bj long, block array<double>"


@dataclass(frozen=True)
class BlockMatrix:
    df: DataFrame
    size: int
    rows: int
    cols: int

    @staticmethod
    def of(m: Matrix, size: int) -> BlockMatrix:
        return BlockMatrix(m.blocks(size).select(F.col("bi").cast("long").alias("bi"), F.col("bj").cast("long").alias("bj"), "block"), size, m.rows, m.cols)

    def matrix(self) -> Matrix:
        """The entries that aren't zero."""
        return Matrix.from_blocks(self.df, self.size, self.rows, self.cols)

    def _with(self, df: DataFrame) -> BlockMatrix:
        return BlockMatrix(df.select("bi", "bj", "block"), self.size, self.rows, self.cols)

    def map(self, f: Callable[[Column], Column]) -> BlockMatrix:
        """f on every cell of the stored blocks, their zeros too."""
        return self._with(self.df.withColumn("block", F.transform("block", f)))

    def transpose(self) -> BlockMatrix:
        n = self.size
        turned = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.get("block", (k % n * n + F.floor(k / n)).cast("int")))
        return BlockMatrix(self.df.select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), turned.alias("block")), n, self.cols, self.rows)

    adjoint = transpose

    def diagonal(self) -> Matrix:
        n = self.size
        cells = self.df.where("bi = bj").select("bi", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get("block", (k * (n + 1)).cast("int")))).alias("k", "v"))
        return Matrix(cells.select((F.col("bi") * n + F.col("k")).alias("i"), F.lit(0).cast("long").alias("j"), "v").where("v != 0"), min(self.rows, self.cols), 1)

    def _pair(self, other: BlockMatrix, how: str) -> DataFrame:
        return self.df.withColumnRenamed("block", "a").join(other.df.withColumnRenamed("block", "b"), ["bi", "bj"], how)

    def conjunction(self, other: BlockMatrix, f: Callable[[Column, Column], Column] = lambda a, b: a * b) -> BlockMatrix:
        """f cell by cell where both have a block."""
        return self._with(self._pair(other, "inner").withColumn("block", F.zip_with("a", "b", f)))

    def disjunction(self, other: BlockMatrix, f: Callable[[Column, Column], Column] = lambda a, b: a + b) -> BlockMatrix:
        """f cell by cell where either has a block, a missing one read as zeros."""
        zeros = F.array_repeat(F.lit(0.0), self.size * self.size)
        return self._with(self._pair(other, "full").withColumn("block", F.zip_with(F.coalesce("a", zeros), F.coalesce("b", zeros), f)))

    def __add__(self, other: BlockMatrix) -> BlockMatrix:
        return self.disjunction(other)

    def __sub__(self, other: BlockMatrix) -> BlockMatrix:
        return self.disjunction(other, lambda a, b: a - b)

    def triangular(self, mode: str = "lower") -> BlockMatrix:
        """lower, upper, strictly_lower or strictly_upper; blocks on the diagonal are masked."""
        n, lower, strict = self.size, mode.endswith("lower"), mode.startswith("strictly")
        row, col = (lambda k: F.floor(k / n)), (lambda k: k % n)
        test = (lambda k: row(k) > col(k) if strict else row(k) >= col(k)) if lower else (lambda k: row(k) < col(k) if strict else row(k) <= col(k))
        masked = F.transform("block", lambda v, k: F.when(test(k), v).otherwise(0.0))
        kept = self.df.where("bi >= bj" if lower else "bi <= bj")
        return self._with(kept.withColumn("block", F.when(F.col("bi") == F.col("bj"), masked).otherwise(F.col("block"))))

    def selfadjoint(self, half: str = "lower") -> BlockMatrix:
        """The symmetric matrix of which one triangle is read."""
        kept = self.triangular(half)
        other = self.triangular(f"strictly_{half}").transpose()
        return kept + BlockMatrix(other.df, self.size, self.rows, self.cols)

    def product(self, other: BlockMatrix) -> BlockMatrix:
        """Join on the inner block index, one batched product, partial sums in the batch, then one sum by block."""
        if self.cols != other.rows or self.size != other.size:
            raise ValueError("the extents or block sizes differ")
        n = self.size

        def multiplied(frames):
            for pdf in frames:
                if len(pdf):
                    a, b = (np.stack(pdf[c].to_numpy()).reshape(-1, n, n) for c in "ab")
                    yield _summed(pdf["bi"].to_numpy(), pdf["bj"].to_numpy(), (a @ b).reshape(-1, n * n))

        def total(pdf: pd.DataFrame) -> pd.DataFrame:
            return _summed(pdf["bi"].to_numpy(), pdf["bj"].to_numpy(), np.stack(pdf["block"].to_numpy()))

        left = self.df.select("bi", F.col("bj").alias("k"), F.col("block").alias("a"))
        right = other.df.select(F.col("bi").alias("k"), "bj", F.col("block").alias("b"))
        parts = left.join(right, "k").select("bi", "bj", "a", "b").mapInPandas(multiplied, SCHEMA)
        return BlockMatrix(parts.groupBy("bi", "bj").applyInPandas(total, SCHEMA), n, self.rows, other.cols)

    __matmul__ = product

    def times(self, x: Matrix) -> Matrix:
        """The product with a dense or sparse matrix, taken in blocks too."""
        return self.product(BlockMatrix.of(x, self.size)).matrix()

    def triangular_solve(self, b: Matrix, mode: str = "lower") -> Matrix:
        return sparse_direct.solve(self.matrix(), b, mode)


def _summed(bi: np.ndarray, bj: np.ndarray, blocks: np.ndarray) -> pd.DataFrame:
    keys, at = np.unique(np.stack([bi, bj], 1), axis=0, return_inverse=True)
    out = np.zeros((len(keys), blocks.shape[1]))
    np.add.at(out, at.ravel(), blocks)
    return pd.DataFrame({"bi": keys[:, 0], "bj": keys[:, 1], "block": list(out)})
