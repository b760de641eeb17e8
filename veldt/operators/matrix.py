"""Matrices as relations (i, j, v): a lazy DataFrame and two extents.

A missing row is a zero. Methods return new matrices and run no job; sums and the like
return one-row DataFrames. Indexes are renamed and filtered without a shuffle, sums of
matrices are a union and one aggregate, products a join on the inner index and one
aggregate with partial sums. A side is broadcast only where its extents bound its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.functions import elementwise as E
from veldt.operators.index import resolve
from veldt.operators.lineage import cut
from veldt.operators.reducers import Reducer, Visitor, reduced, visited

#: A side with at most so many entries (24 bytes each) may be broadcast.
BROADCAST_CELLS = 500_000
#: A dense grid of more cells isn't made.
DENSE_CELLS = 1 << 34

# functions, as a Column can't be made before there is a session
def i() -> Column:
    return F.col("i")


def j() -> Column:
    return F.col("j")


def v() -> Column:
    return F.col("v")


def bounded(df: DataFrame, cells: int) -> DataFrame:
    """A broadcast hint where the extents bound the rows, else the table as it is (a shuffled join)."""
    return F.broadcast(df) if cells <= BROADCAST_CELLS else df


@dataclass(frozen=True)
class Matrix:
    df: DataFrame
    rows: int
    cols: int

    # ---- making

    @staticmethod
    def from_triplets(df: DataFrame, rows: int, cols: int, combine: str | Callable[[Column], Column] = "sum", order: Column | None = None) -> Matrix:
        """Duplicates are combined: "sum", "last" or "first" (by `order`), or an aggregate of v."""
        if combine == "sum":
            out = F.sum("v")
        elif combine == "last":
            out = F.max_by("v", order)
        elif combine == "first":
            out = F.min_by("v", order)
        else:
            out = combine(v())
        return Matrix(df.groupBy("i", "j").agg(out.alias("v")), rows, cols)

    @staticmethod
    def from_writes(writes: DataFrame, rows: int, cols: int, order: Column, add: bool = False) -> Matrix:
        """Random single writes (i, j, v), in any order: the last by `order` stays, or with add all are added up."""
        return Matrix.from_triplets(writes, rows, cols, "sum" if add else "last", order)

    def set_from_sorted(self, batch: DataFrame) -> Matrix:
        """The batch's triplets (duplicates summed) instead of what is stored; an empty batch leaves that as it is."""
        empty = batch.limit(1).agg((F.count("*") == 0).alias("_empty"))
        kept = self.df.crossJoin(F.broadcast(empty)).where("_empty").select("i", "j", "v")
        return self._with(kept.unionByName(batch.groupBy("i", "j").agg(F.sum("v").alias("v"))))

    @staticmethod
    def zero(spark: SparkSession, rows: int, cols: int) -> Matrix:
        return Matrix(spark.range(0).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("v")), rows, cols)

    @staticmethod
    def generate(spark: SparkSession, rows: int, cols: int, f: Callable[[Column, Column], Column]) -> Matrix:
        """v = f(i, j) for all cells; one range, no join."""
        if rows * cols > DENSE_CELLS:
            raise ValueError("a dense matrix of this size isn't made")
        cells = spark.range(rows * cols).select(F.floor(F.col("id") / F.lit(max(cols, 1))).cast("long").alias("i"), (F.col("id") % F.lit(max(cols, 1))).alias("j"))
        return Matrix(cells.select("i", "j", f(i(), j()).cast("double").alias("v")), rows, cols)

    @staticmethod
    def constant(spark: SparkSession, rows: int, cols: int, value: float) -> Matrix:
        return Matrix.generate(spark, rows, cols, lambda a, b: F.lit(float(value)))

    @staticmethod
    def ones(spark: SparkSession, rows: int, cols: int) -> Matrix:
        return Matrix.constant(spark, rows, cols, 1.0)

    @staticmethod
    def identity(spark: SparkSession, n: int, m: int | None = None) -> Matrix:
        m = n if m is None else m
        return Matrix(spark.range(min(n, m)).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), n, m)

    @staticmethod
    def unit(spark: SparkSession, n: int, k: int) -> Matrix:
        return Matrix(spark.range(1).select(F.lit(k).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(1.0).alias("v")), n, 1)

    @staticmethod
    def random(spark: SparkSession, rows: int, cols: int, seed: int = 0, normal: bool = False) -> Matrix:
        """Uniform in [-1, 1], or standard normal."""
        return Matrix.generate(spark, rows, cols, lambda a, b: F.randn(seed) if normal else F.rand(seed) * 2 - 1)

    @staticmethod
    def linspaced(spark: SparkSession, n: int, low: float, high: float) -> Matrix:
        """n points from low to high, both exact; counted from the end of smaller magnitude; n = 1 gives high."""
        k = F.col("id")
        step = (high - low) / (n - 1) if n > 1 else 0.0
        if abs(high) < abs(low):
            value = F.when(k == 0, F.lit(float(low))).otherwise(F.lit(float(high)) - (n - 1 - k) * F.lit(step))
        else:
            value = F.when(k == n - 1, F.lit(float(high))).otherwise(F.lit(float(low)) + k * F.lit(step))
        return Matrix(spark.range(n).select(k.alias("i"), F.lit(0).cast("long").alias("j"), value.alias("v")), n, 1)

    @staticmethod
    def equalspaced(spark: SparkSession, n: int, low: float, step: float) -> Matrix:
        return Matrix(spark.range(n).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), (F.lit(float(low)) + F.col("id") * F.lit(float(step))).alias("v")), n, 1)

    @staticmethod
    def values(spark: SparkSession, table: Sequence[Sequence[float]]) -> Matrix:
        rows = [(a, b, float(x)) for a, r in enumerate(table) for b, x in enumerate(r)]
        return Matrix(spark.createDataFrame(rows, "i long, j long, v double"), len(table), len(table[0]) if table else 0)

    @staticmethod
    def from_arrays(df: DataFrame, row_column: str, array_column: str, rows: int, cols: int) -> Matrix:
        """A row per array cell."""
        return Matrix(df.select(F.col(row_column).cast("long").alias("i"), F.posexplode(array_column).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")), rows, cols)

    @staticmethod
    def from_csr(spark: SparkSession, outer: Sequence[int], inner: Sequence[int], values: Sequence[float], cols: int) -> Matrix:
        rows = [(r, inner[k], float(values[k])) for r in range(len(outer) - 1) for k in range(outer[r], outer[r + 1])]
        return Matrix(spark.createDataFrame(rows, "i long, j long, v double"), len(outer) - 1, cols)

    @staticmethod
    def from_buffer(spark: SparkSession, buffer: Sequence[float], rows: int, cols: int, inner: int = 1, outer: int | None = None, order: str = "col") -> Matrix:
        """A matrix over a flat buffer by strides: inner between neighbours in storage order, outer between columns (or rows)."""
        outer = (rows if order == "col" else cols) * inner if outer is None else outer
        at = (lambda a, b: a * inner + b * outer) if order == "col" else (lambda a, b: a * outer + b * inner)
        return Matrix.values(spark, [[buffer[at(a, b)] for b in range(cols)] for a in range(rows)])

    def to_arrays(self) -> DataFrame:
        """(i, row): dense rows as array cells; zero rows are missing."""
        held = F.map_from_entries(F.collect_list(F.struct("j", "v")))
        return self.df.groupBy("i").agg(held.alias("m")).select("i", F.transform(F.sequence(F.lit(0), F.lit(self.cols - 1)), lambda k: F.coalesce(F.try_element_at("m", k.cast("long")), F.lit(0.0))).alias("row"))

    def _with(self, df: DataFrame, rows: int | None = None, cols: int | None = None) -> Matrix:
        return Matrix(df, self.rows if rows is None else rows, self.cols if cols is None else cols)

    def _moved(self, a: Column, b: Column, rows: int | None = None, cols: int | None = None, where: Column | None = None) -> Matrix:
        df = self.df if where is None else self.df.where(where)
        return self._with(df.select(a.cast("long").alias("i"), b.cast("long").alias("j"), "v"), rows, cols)

    # ---- indexing and shape

    def coeff(self, a: int, b: int) -> DataFrame:
        return self.df.where((i() == a) & (j() == b)).agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("v"))

    def block(self, a: int, b: int, rows: int, cols: int) -> Matrix:
        inside = (i() >= a) & (i() < a + rows) & (j() >= b) & (j() < b + cols)
        return self._moved(i() - a, j() - b, rows, cols, inside)

    def row(self, k: int) -> Matrix:
        return self.block(k, 0, 1, self.cols)

    def col(self, k: int) -> Matrix:
        return self.block(0, k, self.rows, 1)

    def top_rows(self, n: int) -> Matrix:
        return self.block(0, 0, n, self.cols)

    def bottom_rows(self, n: int) -> Matrix:
        return self.block(self.rows - n, 0, n, self.cols)

    def middle_rows(self, a: int, n: int) -> Matrix:
        return self.block(a, 0, n, self.cols)

    def left_cols(self, n: int) -> Matrix:
        return self.block(0, 0, self.rows, n)

    def right_cols(self, n: int) -> Matrix:
        return self.block(0, self.cols - n, self.rows, n)

    def middle_cols(self, b: int, n: int) -> Matrix:
        return self.block(0, b, self.rows, n)

    def corner(self, which: str, rows: int, cols: int) -> Matrix:
        """which: top_left, top_right, bottom_left, bottom_right."""
        top, left = which.startswith("top"), which.endswith("left")
        return self.block(0 if top else self.rows - rows, 0 if left else self.cols - cols, rows, cols)

    def segment(self, start: int, n: int) -> Matrix:
        return self.block(start, 0, n, 1) if self.cols == 1 else self.block(0, start, 1, n)

    def head(self, n: int) -> Matrix:
        return self.segment(0, n)

    def tail(self, n: int) -> Matrix:
        return self.segment(max(self.rows, self.cols) - n, n)

    def indexed(self, row_index=None, col_index=None) -> Matrix:
        """Gather rows and columns by index lists or expressions (see operators.index); repeats and any order are allowed."""
        out = self
        for name, index in (("i", row_index), ("j", col_index)):
            if index is not None:
                index = resolve(index, self.rows if name == "i" else self.cols)
                table = out.df.sparkSession.createDataFrame(list(enumerate(map(int, index))), "_at long, _from long")
                other = "j" if name == "i" else "i"
                df = out.df.join(bounded(table, len(index)), F.col(name) == F.col("_from")).select(F.col("_at").alias(name), other, "v").select("i", "j", "v")
                out = out._with(df, **{"rows" if name == "i" else "cols": len(index)})
        return out

    def diagonal(self, k: int = 0) -> Matrix:
        n = max(0, min(self.rows, self.cols - k) if k >= 0 else min(self.rows + k, self.cols))
        return self._moved(i() + min(k, 0), F.lit(0), n, 1, j() - i() == k)

    def as_diagonal(self) -> Matrix:
        n = max(self.rows, self.cols)
        return self._moved(i() + j(), i() + j(), n, n)

    def triangular(self, mode: str = "lower") -> Matrix:
        """lower, upper, strictly_lower, strictly_upper, unit_lower or unit_upper."""
        lower = mode.endswith("lower")
        strict = mode.startswith(("strictly", "unit"))
        test = (i() > j() if strict else i() >= j()) if lower else (i() < j() if strict else i() <= j())
        out = self._with(self.df.where(test))
        if mode.startswith("unit"):
            out = out._with(out.df.unionByName(Matrix.identity(self.df.sparkSession, self.rows, self.cols).df))
        return out

    def banded(self, below: int, above: int) -> Matrix:
        return self._with(self.df.where((i() - j() <= below) & (j() - i() <= above)))

    def selfadjoint(self, half: str = "lower") -> Matrix:
        """The symmetric matrix of which one triangle is read."""
        kept = self.triangular(half).df
        return self._with(kept.unionByName(kept.where("i != j").select(j().alias("i"), i().alias("j"), "v")))

    def transpose(self) -> Matrix:
        return self._moved(j(), i(), self.cols, self.rows)

    adjoint = transpose

    def reverse(self, rows: bool = True, cols: bool = True) -> Matrix:
        return self._moved(self.rows - 1 - i() if rows else i(), self.cols - 1 - j() if cols else j())

    def reshaped(self, rows: int, cols: int, order: str = "col") -> Matrix:
        """Cells renumbered in column-major (or order="row" row-major) order."""
        if rows * cols != self.rows * self.cols:
            raise ValueError("the sizes differ")
        if order == "col":
            at = i() + j() * self.rows
            return self._moved(at % rows, F.floor(at / rows), rows, cols)
        at = i() * self.cols + j()
        return self._moved(F.floor(at / cols), at % cols, rows, cols)

    def replicate(self, down: int, across: int) -> Matrix:
        tiles = F.explode(F.sequence(F.lit(0), F.lit(down * across - 1))).alias("t")
        df = self.df.select("i", "j", "v", tiles)
        return self._with(df.select((i() + F.floor(F.col("t") / across) * self.rows).cast("long").alias("i"), (j() + F.col("t") % across * self.cols).cast("long").alias("j"), "v"), self.rows * down, self.cols * across)

    def hcat(self, other: Matrix) -> Matrix:
        return self._with(self.df.unionByName(other._moved(i(), j() + self.cols).df), cols=self.cols + other.cols)

    def vcat(self, other: Matrix) -> Matrix:
        return self._with(self.df.unionByName(other._moved(i() + self.rows, j()).df), rows=self.rows + other.rows)

    def swap_rows(self, a: int, b: int) -> Matrix:
        return self._moved(F.when(i() == a, b).when(i() == b, a).otherwise(i()), j())

    def swap_cols(self, a: int, b: int) -> Matrix:
        return self._moved(i(), F.when(j() == a, b).when(j() == b, a).otherwise(j()))

    def lower_bound(self, col: int, row: int) -> DataFrame:
        """The first stored entry (i, v) of a column at or after a row; none gives a null."""
        return self.df.where((j() == col) & (i() >= row)).agg(F.min(F.struct("i", "v")).alias("m")).select("m.i", "m.v")

    def rotated(self, p: int, q: int, c: float, s: float, side: str = "left") -> Matrix:
        """A plane rotation of rows p and q (side="left") or columns: p becomes c p + s q, q becomes c q - s p."""
        key, other = ("i", "j") if side == "left" else ("j", "i")
        k = F.col(key)
        arms = F.when(k == p, F.array(F.struct(F.lit(p).cast("long").alias("k"), F.lit(c).alias("f")), F.struct(F.lit(q).cast("long").alias("k"), F.lit(-s).alias("f"))))
        arms = arms.when(k == q, F.array(F.struct(F.lit(p).cast("long").alias("k"), F.lit(s).alias("f")), F.struct(F.lit(q).cast("long").alias("k"), F.lit(c).alias("f"))))
        arms = arms.otherwise(F.array(F.struct(k.cast("long").alias("k"), F.lit(1.0).alias("f"))))
        moved = self.df.select(other, "v", F.explode(arms).alias("t")).select(F.col("t.k").alias(key), other, (v() * F.col("t.f")).alias("v"))
        touched = F.col(key).isin(p, q)
        summed = moved.where(touched).groupBy("i", "j").agg(F.sum("v").alias("v"))
        return self._with(moved.where(~touched).select("i", "j", "v").unionByName(summed))

    def conservative_resize(self, rows: int, cols: int) -> Matrix:
        return self._with(self.df.where((i() < rows) & (j() < cols)), rows, cols)

    def remove_cols(self, at: int, n: int) -> Matrix:
        return self._moved(i(), F.when(j() >= at, j() - n).otherwise(j()), cols=self.cols - n, where=(j() < at) | (j() >= at + n))

    def insert_empty_cols(self, at: int, n: int) -> Matrix:
        return self._moved(i(), F.when(j() >= at, j() + n).otherwise(j()), cols=self.cols + n)

    def cast(self, kind: str, wrap: bool = False) -> Matrix:
        return self.map(lambda x: x.try_cast(kind) if wrap else x.cast(kind))

    def to_dense(self) -> Matrix:
        """All cells stored; refused beyond DENSE_CELLS."""
        grid = Matrix.generate(self.df.sparkSession, self.rows, self.cols, lambda a, b: F.lit(0.0))
        return self._with(grid.df.select("i", "j").join(self.df, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v")))

    def pruned(self, reference: float = 1.0, epsilon: float = 1e-12) -> Matrix:
        """Entries with |v| > epsilon * |reference|."""
        return self._with(self.df.where(F.abs(v()) > abs(reference) * epsilon))

    def prune(self, keep: Callable[[Column, Column, Column], Column]) -> Matrix:
        return self._with(self.df.where(keep(i(), j(), v())))

    def pattern(self) -> DataFrame:
        return self.df.select("i", "j")

    # ---- element-wise

    def map(self, f: Callable[[Column], Column]) -> Matrix:
        """f on stored entries; f(0) isn't made (see to_dense)."""
        return self._with(self.df.select("i", "j", f(v()).alias("v")))

    def map_indexed(self, f: Callable[[Column, Column, Column], Column]) -> Matrix:
        return self._with(self.df.select("i", "j", f(i(), j(), v()).alias("v")))

    def eval(self) -> Matrix:
        """The matrix written and read again: its plan ends here (a reliable checkpoint)."""
        return self._with(cut(self.df))

    def __mul__(self, s: float) -> Matrix:
        return self.scale(s)

    __rmul__ = __mul__

    def __truediv__(self, s: float) -> Matrix:
        return self.map(lambda x: E.divide(x, F.lit(float(s))))

    def __neg__(self) -> Matrix:
        return self.map(lambda x: -x)

    def scale(self, s: float) -> Matrix:
        return self.map(lambda x: x * float(s))

    def __add__(self, other: Matrix) -> Matrix:
        return self._with(self.df.unionByName(other.df).groupBy("i", "j").agg(F.sum("v").alias("v")))

    def __sub__(self, other: Matrix) -> Matrix:
        return self + (-other)

    def _pair(self, other: Matrix, how: str) -> DataFrame:
        return self.df.withColumnRenamed("v", "a").join(other.df.withColumnRenamed("v", "b"), ["i", "j"], how)

    def union_op(self, other: Matrix, f: Callable[[Column, Column], Column]) -> Matrix:
        """f over the union of the patterns, a missing side read as 0."""
        a, b = (F.coalesce(F.col(c), F.lit(0.0)) for c in "ab")
        return self._with(self._pair(other, "full").select("i", "j", f(a, b).alias("v")))

    def conjunction(self, other: Matrix, f: Callable[[Column, Column], Column] = lambda a, b: a * b) -> Matrix:
        """f where both are stored."""
        return self._with(self._pair(other, "inner").select("i", "j", f(F.col("a"), F.col("b")).alias("v")))

    def disjunction(self, other: Matrix, f: Callable[[Column, Column], Column]) -> Matrix:
        """f where both are stored, else the one that is."""
        a, b = F.col("a"), F.col("b")
        return self._with(self._pair(other, "full").select("i", "j", F.when(a.isNull(), b).when(b.isNull(), a).otherwise(f(a, b)).alias("v")))

    def cwise_product(self, other: Matrix) -> Matrix:
        return self.conjunction(other)

    def cwise_quotient(self, dense: Matrix) -> Matrix:
        return self.conjunction(dense, E.divide)

    def select(self, then: Matrix, other: Matrix) -> Matrix:
        """then where this mask holds (stored and not 0), else other."""
        mask = self.df.select("i", "j", (v().cast("double") != 0).alias("m"))
        df = then._pair(other, "full").join(mask, ["i", "j"], "left").select("i", "j", F.when(F.coalesce("m", F.lit(False)), F.col("a")).otherwise(F.col("b")).alias("v"))
        return self._with(df.where("v is not null"))

    def insert_triplets(self, batch: DataFrame, combine: str = "sum") -> Matrix:
        """Merge a batch (i, j, v) into the stored entries: sum, or last (the batch wins)."""
        if combine == "sum":
            return self._with(self.df.unionByName(batch).groupBy("i", "j").agg(F.sum("v").alias("v")))
        both = self.df.withColumn("_t", F.lit(0)).unionByName(batch.withColumn("_t", F.lit(1)))
        return self._with(both.groupBy("i", "j").agg(F.max_by("v", "_t").alias("v")))

    # ---- broadcasting over rows and columns

    def broadcast_op(self, vector: Matrix, f: Callable[[Column, Column], Column], along: str = "rows") -> Matrix:
        """Each row (along="rows") or column combined with a vector of matching length, missing entries 0; stored entries only."""
        key, n = ("j", self.cols) if along == "rows" else ("i", self.rows)
        w = vector.df.select((i() + j()).alias(key), v().alias("w"))
        return self._with(self.df.join(bounded(w, n), key, "left").select("i", "j", f(v(), F.coalesce("w", F.lit(0.0))).alias("v")))

    # ---- reductions

    def reduce(self, *aggregates: Column) -> DataFrame:
        return self.df.agg(*aggregates)

    def sum(self) -> Column:
        return F.coalesce(F.sum("v"), F.lit(0.0))

    def aggregate(self, name: str, size: int | None = None) -> Column:
        """The named reduction as an aggregate of v; the extents (or a size) fill in for structural zeros."""
        size = self.rows * self.cols if size is None else size
        full = F.count(v()) == size
        finite = F.when(~F.isnan(v()), v())
        table: dict[str, Column] = {
            "sum": self.sum(), "mean_of_stored": F.avg("v"), "prod": F.when(full, F.coalesce(F.product("v"), F.lit(1.0))).otherwise(F.lit(0.0)),
            "mean": self.sum() / F.lit(float(size) if size else float("nan")),
            "min": F.when(full, F.min(finite)).otherwise(F.least(F.min(finite), F.lit(0.0))), "max": F.when(full, F.max(finite)).otherwise(F.greatest(F.max(finite), F.lit(0.0))),
            "min_nan": F.when(F.bool_or(F.isnan(v())), F.lit(float("nan"))).when(full, F.min("v")).otherwise(F.least(F.min("v"), F.lit(0.0))),
            "max_nan": F.when(F.bool_or(F.isnan(v())), F.lit(float("nan"))).when(full, F.max("v")).otherwise(F.greatest(F.max("v"), F.lit(0.0))),
            "squared_norm": F.coalesce(F.sum(v() * v()), F.lit(0.0)), "norm": F.sqrt(F.coalesce(F.sum(v() * v()), F.lit(0.0))),
            "l1": F.coalesce(F.sum(F.abs(v())), F.lit(0.0)), "linf": F.coalesce(F.max(F.abs(v())), F.lit(0.0)),
            "trace": F.coalesce(F.sum(F.when(i() == j(), v())), F.lit(0.0)), "nonzeros": F.count(v()), "count": F.count_if(v() != 0),
            "all": F.when(full, F.coalesce(F.bool_and(v() != 0), F.lit(True))).otherwise(F.lit(False)), "any": F.coalesce(F.bool_or(v() != 0), F.lit(False)),
            "has_nan": F.coalesce(F.bool_or(F.isnan(v())), F.lit(False)), "all_finite": F.coalesce(F.bool_and(E.is_finite(v())), F.lit(True)),
        }
        return table[name].alias(name)

    def lp_norm(self, p: float) -> DataFrame:
        out = F.max(F.abs(v())) if p == float("inf") else F.pow(F.sum(F.pow(F.abs(v()), F.lit(float(p)))), F.lit(1.0 / p))
        return self.df.agg(F.coalesce(out, F.lit(0.0)).alias("norm"))

    def stable_norm(self) -> DataFrame:
        """The 2-norm without overflow: scaled by the largest magnitude, in two passes."""
        top = self.df.agg(F.max(F.abs(v())).alias("m"))
        return self.df.crossJoin(F.broadcast(top)).agg(F.coalesce(F.max("m") * F.sqrt(F.sum(F.when(F.col("m") > 0, v() / F.col("m") * (v() / F.col("m"))).otherwise(0.0))), F.lit(0.0)).alias("norm"))

    def rowwise(self, *names: str, **aggregates: Column) -> DataFrame:
        """By row: named reductions (see aggregate; structural zeros count), and aggregates of the stored j and v. Zero rows are missing."""
        return self.df.groupBy("i").agg(*[self.aggregate(n, self.cols) for n in names], *[c.alias(k) for k, c in aggregates.items()])

    def colwise(self, *names: str, **aggregates: Column) -> DataFrame:
        return self.df.groupBy("j").agg(*[self.aggregate(n, self.rows) for n in names], *[c.alias(k) for k, c in aggregates.items()])

    def linear(self, order: str = "col") -> Column:
        return i() + j() * self.rows if order == "col" else i() * self.cols + j()

    def arg_extreme(self, largest: bool = True, by: str | None = None, order: str = "col") -> DataFrame:
        """Value and place of the extreme entry, the first in storage order among equals; by="i" or "j" for each row or column.

        Structural zeros are entries: where some are missing and no stored entry is better than
        0, the first zero, stored or not, is the extreme. Zero rows (or columns, or a zero
        matrix) are missing.
        """
        sign = -1.0 if largest else 1.0
        at, value = self.linear(order), (v() * sign).alias("k")
        best = F.min(F.struct(value, at.alias("at"), "i", "j")).alias("m")
        keys = [by] if by else []
        size = {"i": self.cols, "j": self.rows, None: self.rows * self.cols}[by]
        found = self.df.groupBy(*keys).agg(best, F.count("v").alias("n")).where("n > 0")
        if size <= 1:
            return found.select(*keys, (F.col("m.k") * sign + 0.0).alias("v"), *[F.col(f"m.{c}").alias(c) for c in "ij" if c != by])
        # groups whose extreme is a zero that isn't stored: the first missing place is 0, or follows a stored one
        need = found.where((F.col("n") < size) & (F.col("m.k") >= 0)).select(*keys, F.lit(True).alias("_need"))
        stored = self.df.join(need, keys, "left_semi") if by else self.df.crossJoin(F.broadcast(need)).drop("_need")
        # a place along the storage order: within a row or column, or of the whole matrix
        step = {"i": j(), "j": i(), None: self.linear(order)}[by]
        places = stored.select(*keys, step.alias("p"), F.lit(1).alias("here"))
        next_places = places.select(*keys, (F.col("p") + 1).alias("p"), F.lit(0).alias("here")).where(F.col("p") < size)
        origin = need.select(*keys, F.lit(0).cast("long").alias("p"), F.lit(0).alias("here"))
        gaps = places.unionByName(next_places).unionByName(origin).groupBy(*keys, "p").agg(F.max("here").alias("here")).where("here = 0").groupBy(*keys).agg(F.min("p").alias("gap")).where("gap is not null")
        gap_i = {"i": F.col("i"), "j": F.col("gap"), None: F.col("gap") % self.rows if order == "col" else F.floor(F.col("gap") / self.cols)}[by]
        gap_j = {"i": F.col("gap"), "j": F.col("j"), None: F.floor(F.col("gap") / self.rows) if order == "col" else F.col("gap") % self.cols}[by]
        zero = gaps.select(*keys, F.struct(F.lit(0.0).alias("k"), (gap_i + gap_j * self.rows if order == "col" else gap_i * self.cols + gap_j).cast("long").alias("at"), gap_i.cast("long").alias("i"), gap_j.cast("long").alias("j")).alias("m"))
        both = found.select(*keys, "m").unionByName(zero).groupBy(*keys).agg(F.min("m").alias("m")).where("m is not null")
        return both.select(*keys, (F.col("m.k") * sign + 0.0).alias("v"), *[F.col(f"m.{c}").alias(c) for c in "ij" if c != by])

    def normalized(self) -> Matrix:
        """Divided by the norm; a zero matrix stays."""
        n = self.df.agg(self.aggregate("norm"))
        return self._with(self.df.crossJoin(F.broadcast(n)).select("i", "j", F.when(F.col("norm") > 0, v() / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).otherwise(v()).alias("v")))

    def rowwise_normalized(self, by: str = "i") -> Matrix:
        """Rows (or columns) divided by their norms, which are one aggregate and come back by a join: a long row is no single task."""
        norms = self.df.groupBy(by).agg(F.sqrt(F.sum(v() * v())).alias("n"))
        n = F.col("n")
        df = self.df.join(bounded(norms, self.rows if by == "i" else self.cols), by)
        return self._with(df.select("i", "j", F.when(n > 0, v() / F.when(n > 0, n).otherwise(1.0)).otherwise(v()).alias("v")))

    def dot(self, other: Matrix) -> DataFrame:
        return self._pair(other, "inner").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("dot"))

    def is_approx(self, other: Matrix, precision: float = 1e-12) -> DataFrame:
        """|x - y|**2 <= precision**2 * min(|x|**2, |y|**2)."""
        a, b = (F.coalesce(F.col(c), F.lit(0.0)) for c in "ab")
        sums = self._pair(other, "full").agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(n) for n, x in (("d", (a - b) * (a - b)), ("x", a * a), ("y", b * b))])
        return sums.select((F.col("d") <= precision * precision * F.least("x", "y")).alias("is_approx"))

    def equals(self, other: Matrix) -> DataFrame:
        a, b = (F.coalesce(F.col(c), F.lit(0.0)) for c in "ab")
        return self._pair(other, "full").agg((F.coalesce(F.count_if(~E.BINARY["eq"](a, b)), F.lit(0)) == 0).alias("equal"))

    def is_much_smaller_than(self, other: Matrix, precision: float = 1e-12) -> DataFrame:
        """|x|**2 <= precision**2 * |y|**2."""
        both = self.df.select((v() * v()).alias("x"), F.lit(0.0).alias("y")).unionByName(other.df.select(F.lit(0.0).alias("x"), (v() * v()).alias("y")))
        sums = both.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("y"))
        return sums.select((F.col("x") <= precision * precision * F.col("y")).alias("is_much_smaller"))

    def is_constant(self, value: float | None = None, precision: float = 1e-12) -> DataFrame:
        """All entries within precision (relative) of value, by default of the first entry."""
        size = self.rows * self.cols
        low, high = F.coalesce(F.min("v"), F.lit(0.0)), F.coalesce(F.max("v"), F.lit(0.0))
        low, high = (F.when(F.count("v") == size, x).otherwise(y) for x, y in ((low, F.least(low, F.lit(0.0))), (high, F.greatest(high, F.lit(0.0)))))
        want = F.coalesce(F.sum(F.when((i() == 0) & (j() == 0), v())), F.lit(0.0)) if value is None else F.lit(float(value))
        near = lambda x: F.abs(x - want) <= F.lit(precision) * F.least(F.abs(x), F.abs(want))
        return self.df.agg((near(low) & near(high)).alias("is_constant"))

    def shape_test(self, name: str, precision: float = 1e-12) -> DataFrame:
        """zero, ones, identity, diagonal, upper_triangular, lower_triangular or skew_symmetric, relative to the largest entry."""
        top, limit = F.coalesce(F.max(F.abs(v())), F.lit(0.0)), F.lit(precision)
        worst = lambda test, x=F.abs(v()): F.coalesce(F.max(F.when(test, x)), F.lit(0.0))
        if name == "zero":
            out = top <= limit
        elif name == "ones":
            out = (F.count(v()) == self.rows * self.cols) & (worst(F.lit(True), F.abs(v() - 1)) <= limit)
        elif name == "identity":
            out = (worst(i() != j()) <= limit) & (worst(i() == j(), F.abs(v() - 1)) <= limit) & (F.count_if(i() == j()) == min(self.rows, self.cols))
        elif name == "skew_symmetric":
            return (self + self.transpose()).df.agg((F.coalesce(F.max(F.abs(v())), F.lit(0.0)) <= limit).alias(name))
        else:
            out = worst({"diagonal": i() != j(), "upper_triangular": i() > j(), "lower_triangular": i() < j()}[name]) <= limit * top
        return self.df.agg(out.alias(name))

    def is_orthogonal(self, other: Matrix, precision: float = 1e-12) -> DataFrame:
        """|x . y|**2 <= precision**2 |x|**2 |y|**2."""
        pair = self._pair(other, "full")
        a, b = (F.coalesce(F.col(c), F.lit(0.0)) for c in "ab")
        sums = pair.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(n) for n, x in (("d", a * b), ("x", a * a), ("y", b * b))])
        return sums.select((F.col("d") * F.col("d") <= precision * precision * F.col("x") * F.col("y")).alias("is_orthogonal"))

    def is_unitary(self, precision: float = 1e-12) -> DataFrame:
        return (self.transpose() @ self).shape_test("identity", precision)

    def reduce_with(self, reducer: Reducer, by: str | None = None) -> DataFrame:
        """A user's reduction of all entries, or by row ("i") or column ("j"); structural zeros go to reducer.zeros where it has that."""
        size = {None: self.rows * self.cols, "i": self.cols, "j": self.rows}[by]
        return reduced(self.df, [by] if by else [], reducer, size if hasattr(reducer, "zeros") else None)

    def visit(self, visitor: Visitor) -> DataFrame:
        """A user's visitor over the stored entries, with their places."""
        return visited(self.df, ["i", "j"], visitor)

    def entries(self):
        """The stored entries (i, j, v) in column order, a partition at a time on the driver."""
        for r in self.df.orderBy("j", "i").toLocalIterator():
            yield r["i"], r["j"], r["v"]

    def inner_indices_sorted(self) -> DataFrame:
        """Whether each column's entries lie in ascending row order in the table as it is stored: within its partition, none after a larger one."""
        at = F.monotonically_increasing_id()
        w = Window.partitionBy("j", F.shiftrightunsigned("_at", 33)).orderBy("_at")
        steps = self.df.withColumn("_at", at).withColumn("_d", i() - F.lag("i").over(w))
        return steps.agg((F.coalesce(F.min("_d"), F.lit(1)) > 0).alias("sorted"))

    # ---- products

    def __matmul__(self, other: Matrix) -> Matrix:
        return self.product(other)

    def product(self, other: Matrix, salts: int = 1) -> Matrix:
        """Join on the inner index, partial sums, one aggregate. Numeric zeros stay stored.

        An inner index with very many entries on both sides is one key of the join: with salts
        it is dealt to that many tasks, and the right side is copied as often. The copies are
        never broadcast: Spark guesses their size from the uncopied side. Entries that repeat
        an index are added up by the product's own sum.
        """
        if self.cols != other.rows:
            raise ValueError("the inner extents differ")
        left = self.df.select("i", j().alias("k"), v().alias("a"))
        right = other.df.select(i().alias("k"), "j", v().alias("b"))
        keys = ["k"]
        if other.rows * other.cols <= BROADCAST_CELLS:
            right = F.broadcast(right)
        elif self.rows * self.cols <= BROADCAST_CELLS:
            left = F.broadcast(left)
        elif salts > 1:
            left = left.withColumn("s", F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int"))
            right = right.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
            keys = ["k", "s"]
        df = left.join(right, keys).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
        return Matrix(df, self.rows, other.cols)

    def product_pruned(self, other: Matrix, tolerance: float = 0.0) -> Matrix:
        out = self @ other
        return out._with(out.df.where(F.abs(v()) > tolerance))

    def scale_rows(self, diagonal: Matrix) -> Matrix:
        """diag(d) * A."""
        d = diagonal.df.select(i().alias("i"), v().alias("d"))
        return self._with(self.df.join(bounded(d, self.rows), "i").select("i", "j", (v() * F.col("d")).alias("v")))

    def scale_cols(self, diagonal: Matrix) -> Matrix:
        d = diagonal.df.select(i().alias("j"), v().alias("d"))
        return self._with(self.df.join(bounded(d, self.cols), "j").select("i", "j", (v() * F.col("d")).alias("v")))

    def permuted(self, left: DataFrame | None = None, right: DataFrame | None = None) -> Matrix:
        """P * A and A * Q for permutations (i, p): row (or column) i goes to p."""
        df = self.df
        if left is not None:
            df = df.join(bounded(left.select(F.col("i"), F.col("p").alias("_p")), self.rows), "i").select(F.col("_p").alias("i"), "j", "v")
        if right is not None:
            df = df.join(bounded(right.select(F.col("i").alias("j"), F.col("p").alias("_p")), self.cols), "j").select("i", F.col("_p").alias("j"), "v")
        return self._with(df)

    def twisted_by(self, permutation: DataFrame) -> Matrix:
        """P A P^T."""
        return self.permuted(permutation, permutation)

    def gram(self) -> Matrix:
        """A^T A from pairs within each row; the lower half is computed and mirrored."""
        a = self.df.select("i", j().alias("j1"), v().alias("a"))
        b = self.df.select("i", j().alias("j2"), v().alias("b"))
        half = a.join(b, "i").where("j1 >= j2").groupBy("j1", "j2").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
        return Matrix(half.select(F.col("j1").alias("i"), F.col("j2").alias("j"), "v"), self.cols, self.cols).selfadjoint("lower")

    def rank_update(self, u: Matrix, alpha: float = 1.0, w: Matrix | None = None) -> Matrix:
        """A + alpha u u^T, or A + alpha (u w^T + w u^T)."""
        if w is None:
            return self + (u @ u.transpose()).scale(alpha)
        return self + (u @ w.transpose()).scale(alpha) + (w @ u.transpose()).scale(alpha)

    def kronecker(self, other: Matrix) -> Matrix:
        b = other.df.select(i().alias("k"), j().alias("l"), v().alias("b"))
        df = self.df.crossJoin(bounded(b, other.rows * other.cols))
        return Matrix(df.select((i() * other.rows + F.col("k")).alias("i"), (j() * other.cols + F.col("l")).alias("j"), (v() * F.col("b")).alias("v")), self.rows * other.rows, self.cols * other.cols)

    def outer(self, other: Matrix) -> Matrix:
        return self @ other.transpose()

    def power(self, n: int) -> Matrix:
        """A**n for n >= 0 by squaring."""
        out, base = Matrix.identity(self.df.sparkSession, self.rows), self
        while n:
            out = out @ base if n & 1 else out
            n >>= 1
            base = base @ base if n else base
        return out

    # ---- order

    def sorted_inner(self, by: str = "j") -> DataFrame:
        """Entries sorted by index within each column (by="j") or row; one shuffle on the key."""
        other = "i" if by == "j" else "j"
        return self.df.repartition(by).sortWithinPartitions(by, other)

    def sorted_with_permutation(self, by: str = "j", descending: bool = False) -> DataFrame:
        """(i, j, v, place): each column's (or row's) entries ranked by value, ties by index."""
        key, other = (by, "i" if by == "j" else "j")
        w = Window.partitionBy(key).orderBy(v().desc() if descending else v(), other)
        return self.df.select("i", "j", "v", (F.row_number().over(w) - 1).cast("long").alias("place"))

    def top_k(self, k: int, by: str = "i") -> Matrix:
        """The k largest magnitudes of each row or column; ties by index."""
        w = Window.partitionBy(by).orderBy(F.abs(v()).desc(), "i", "j")
        return self._with(self.df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r"))

    def scaled(self, rounds: int = 5) -> tuple[Matrix, DataFrame, DataFrame]:
        """Rows and columns scaled towards largest magnitude 1 in turn; the matrix, (i, l) and (j, r).

        Only the factors change: each half round is one aggregate of the scaled magnitudes, and
        the factors, a row per index, are written as a reliable checkpoint. Zero lines have
        factor 1.
        """
        left = self.df.select("i").distinct().select("i", F.lit(1.0).alias("l"))
        right = self.df.select("j").distinct().select("j", F.lit(1.0).alias("r"))
        scaled = lambda: self.df.join(bounded(left, self.rows), "i").join(bounded(right, self.cols), "j").select("i", "j", (v() * F.col("l") * F.col("r")).alias("v"))
        for _ in range(rounds):
            for key in "ij":
                top = scaled().groupBy(key).agg(F.sqrt(F.max(F.abs(v()))).alias("t"))
                s = F.when(F.col("t") > 0, 1 / F.when(F.col("t") > 0, F.col("t")).otherwise(1.0)).otherwise(F.lit(1.0))
                if key == "i":
                    left = cut(left.join(top, "i").select("i", (F.col("l") * s).alias("l")))
                else:
                    right = cut(right.join(top, "j").select("j", (F.col("r") * s).alias("r")))
        return self._with(scaled()), left, right

    def blocks(self, size: int) -> DataFrame:
        """Block-sparse form (bi, bj, block): dense size x size blocks in row-major order."""
        key = F.struct((i() % size * size + j() % size).cast("int").alias("at"), "v")
        held = self.df.groupBy(F.floor(i() / size).alias("bi"), F.floor(j() / size).alias("bj")).agg(F.map_from_entries(F.collect_list(key)).alias("m"))
        return held.select("bi", "bj", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("block"))

    @staticmethod
    def from_blocks(blocks: DataFrame, size: int, rows: int, cols: int) -> Matrix:
        df = blocks.select("bi", "bj", F.posexplode("block").alias("k", "v")).where("v != 0")
        return Matrix(df.select((F.col("bi") * size + F.floor(F.col("k") / size)).cast("long").alias("i"), (F.col("bj") * size + F.col("k") % size).cast("long").alias("j"), "v"), rows, cols)


def permutation_inverse(p: DataFrame) -> DataFrame:
    """The inverse (also the transpose) of a permutation (i, p)."""
    return p.select(F.col("p").alias("i"), F.col("i").alias("p"))


def permutation_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The permutation that does b first, then a."""
    return b.select("i", F.col("p").alias("_m")).join(a.select(F.col("i").alias("_m"), "p"), "_m").select("i", "p")


def transpositions(spark: SparkSession, steps: Sequence[int]) -> DataFrame:
    """The permutation (i, p) of exchanging 0 with steps[0], then 1 with steps[1], and so on."""
    at = list(range(len(steps)))
    for k, other in enumerate(steps):
        at[k], at[other] = at[other], at[k]
    return spark.createDataFrame([(held, place) for place, held in enumerate(at)], "i long, p long")
