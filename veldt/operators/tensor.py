"""Tensors as relations (d0 ... dn-1, v) with their extents.

Geometry is arithmetic and filters on index columns (no shuffle), reductions group by the
kept dimensions, scans run in two levels of blocks, contraction is a join.
Missing entries read as 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.operators.lineage import cut
from veldt.operators.matrix import DENSE_CELLS, Matrix, bounded
from veldt.operators.reducers import Reducer, reduced

#: A line of more places is transformed in four steps.
FFT_LINE = 1 << 20
#: A line of more places is scanned in blocks of this many.
SCAN_BLOCK = 1 << 20


def v() -> Column:
    return F.col("v")


def d(k: int) -> Column:
    return F.col(f"d{k}")


def _fft_lines(df: DataFrame, names: list[str], keys: list[str], at: str, n: int, inverse: bool) -> DataFrame:
    """Transforms of (names, re, im) along `at`, a group by keys each; missing places are zeros, all places come out."""
    order = [*names, "re", "im"]

    def line(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros(n, complex)
        z[pdf[at].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        z = np.fft.ifft(z) if inverse else np.fft.fft(z)
        out = pd.DataFrame({at: np.arange(n), "re": z.real, "im": z.imag})
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[order]

    grouped = df.groupBy(*keys) if keys else df.groupBy((F.col(at) * 0).alias("_all"))
    return grouped.applyInPandas(line, ", ".join(f"{c} long" for c in names) + ", re double, im double")


@dataclass(frozen=True)
class Tensor:
    df: DataFrame
    dims: tuple[int, ...]

    @property
    def rank(self) -> int:
        return len(self.dims)

    @property
    def names(self) -> list[str]:
        return [f"d{k}" for k in range(self.rank)]

    @staticmethod
    def generate(spark: SparkSession, dims: Sequence[int], f: Callable[..., Column]) -> Tensor:
        """v = f(d0, d1, ...) for all cells."""
        size = prod(dims)
        if size > DENSE_CELLS:
            raise ValueError("a dense tensor of this size isn't made")
        at, cols = F.col("id"), []
        for k, n in enumerate(dims):
            cols.append((at % max(n, 1)).alias(f"d{k}"))
            at = F.floor(at / max(n, 1))
        df = spark.range(size).select(*[c.cast("long").alias(f"d{k}") for k, c in enumerate(cols)])
        return Tensor(df.withColumn("v", f(*[d(k) for k in range(len(dims))]).cast("double")), tuple(dims))

    @staticmethod
    def from_matrix(m: Matrix) -> Tensor:
        return Tensor(m.df.select(F.col("i").alias("d0"), F.col("j").alias("d1"), "v"), (m.rows, m.cols))

    def to_matrix(self) -> Matrix:
        return Matrix(self.df.select(F.col("d0").alias("i"), F.col("d1").alias("j"), "v"), *self.dims)

    def _moved(self, index: Sequence[Column], dims: Sequence[int], where: Column | None = None, value: Column | None = None) -> Tensor:
        df = self.df if where is None else self.df.where(where)
        return Tensor(df.select(*[c.cast("long").alias(f"d{k}") for k, c in enumerate(index)], (v() if value is None else value).alias("v")), tuple(dims))

    def linear(self, layout: str = "col") -> Column:
        """The linear index: the first dimension runs fastest (layout="row": the last)."""
        order = range(self.rank) if layout == "col" else reversed(range(self.rank))
        out, step = F.lit(0).cast("long"), 1
        for k in order:
            out, step = out + d(k) * step, step * self.dims[k]
        return out

    def map(self, f: Callable[[Column], Column]) -> Tensor:
        return Tensor(self.df.withColumn("v", f(v())), self.dims)

    def zip(self, other: Tensor, f: Callable[[Column, Column], Column]) -> Tensor:
        """f over the union of both patterns, missing read as 0."""
        pair = self.df.withColumnRenamed("v", "a").join(other.df.withColumnRenamed("v", "b"), self.names, "full")
        return Tensor(pair.select(*self.names, f(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))).alias("v")), self.dims)

    def to_dense(self, fill: float = 0.0) -> Tensor:
        grid = Tensor.generate(self.df.sparkSession, self.dims, lambda *_: F.lit(0.0)).df.drop("v")
        return Tensor(grid.join(self.df, self.names, "left").select(*self.names, F.coalesce("v", F.lit(float(fill))).alias("v")), self.dims)

    # ---- geometry

    def reshape(self, dims: Sequence[int], layout: str = "col") -> Tensor:
        if prod(dims) != prod(self.dims):
            raise ValueError("the sizes differ")
        at, index = self.linear(layout), {}
        for k in range(len(dims)) if layout == "col" else reversed(range(len(dims))):
            index[k] = at % dims[k]
            at = F.floor(at / dims[k])
        return self._moved([index[k] for k in range(len(dims))], dims)

    def slice(self, offsets: Sequence[int], extents: Sequence[int]) -> Tensor:
        test = F.lit(True)
        for k, (o, n) in enumerate(zip(offsets, extents)):
            test = test & (d(k) >= o) & (d(k) < o + n)
        return self._moved([d(k) - o for k, o in enumerate(offsets)], extents, test)

    def strided_slice(self, start: Sequence[int], stop: Sequence[int], stride: Sequence[int]) -> Tensor:
        """start to stop (exclusive) by stride, which may be negative."""
        test, index, dims = F.lit(True), [], []
        for k, (a, b, s) in enumerate(zip(start, stop, stride)):
            inside = (d(k) >= a) & (d(k) < b) if s > 0 else (d(k) <= a) & (d(k) > b)
            test = test & inside & (F.abs(d(k) - a) % abs(s) == 0)
            index.append(F.floor(F.abs(d(k) - a) / abs(s)))
            dims.append(len(range(a, b, s)))
        return self._moved(index, dims, test)

    def chip(self, dim: int, at: int) -> Tensor:
        kept = [k for k in range(self.rank) if k != dim]
        return self._moved([d(k) for k in kept], [self.dims[k] for k in kept], d(dim) == at)

    def reverse(self, flags: Sequence[bool]) -> Tensor:
        return self._moved([self.dims[k] - 1 - d(k) if f else d(k) for k, f in enumerate(flags)], self.dims)

    def roll(self, shifts: Sequence[int]) -> Tensor:
        """out[x] = in[(x + shift) mod n]."""
        return self._moved([F.pmod(d(k) - s, F.lit(self.dims[k])) for k, s in enumerate(shifts)], self.dims)

    def shuffle(self, order: Sequence[int]) -> Tensor:
        """Dimension k of the result is dimension order[k] of this."""
        return self._moved([d(o) for o in order], [self.dims[o] for o in order])

    def swap_layout(self) -> Tensor:
        return self.shuffle(list(reversed(range(self.rank))))

    def stride(self, steps: Sequence[int]) -> Tensor:
        test = F.lit(True)
        for k, s in enumerate(steps):
            test = test & (d(k) % s == 0)
        return self._moved([F.floor(d(k) / s) for k, s in enumerate(steps)], [-(-n // s) for n, s in zip(self.dims, steps)], test)

    def inflate(self, steps: Sequence[int]) -> Tensor:
        return self._moved([d(k) * s for k, s in enumerate(steps)], [(n - 1) * s + 1 if n else 0 for n, s in zip(self.dims, steps)])

    def pad(self, pairs: Sequence[tuple[int, int]], value: float = 0.0) -> Tensor:
        dims = [n + a + b for n, (a, b) in zip(self.dims, pairs)]
        out = self._moved([d(k) + a for k, (a, _) in enumerate(pairs)], dims)
        if value == 0:
            return out
        inside = F.lit(True)
        for k, (a, _) in enumerate(pairs):
            inside = inside & (d(k) >= a) & (d(k) < a + self.dims[k])
        frame = Tensor.generate(self.df.sparkSession, dims, lambda *_: F.lit(float(value)))
        return Tensor(frame.df.where(~inside).unionByName(out.df), tuple(dims))

    def broadcast(self, times: Sequence[int]) -> Tensor:
        df = self.df
        for k, t in enumerate(times):
            if t > 1:
                df = df.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(t - 1)))).withColumn(f"d{k}", d(k) + F.col("_t") * self.dims[k]).drop("_t")
        return Tensor(df.select(*self.names, "v"), tuple(n * t for n, t in zip(self.dims, times)))

    def concatenate(self, other: Tensor, axis: int) -> Tensor:
        moved = other._moved([d(k) + (self.dims[axis] if k == axis else 0) for k in range(self.rank)], other.dims)
        return Tensor(self.df.unionByName(moved.df), tuple(n + (other.dims[k] if k == axis else 0) for k, n in enumerate(self.dims)))

    def index_pairs(self, layout: str = "col") -> DataFrame:
        return self.df.select(self.linear(layout).alias("index"), "v")

    def symmetrized_by(self, generators: Sequence[tuple[Sequence[int], int]]) -> Tensor:
        """Each stored entry at all its places under the group that (order of dimensions, sign) generators span; entries that come to one place must agree."""
        start = (tuple(range(self.rank)), 1)
        group, frontier = {start[0]: 1}, [start]
        while frontier:
            order, sign = frontier.pop()
            for g, s in generators:
                image = tuple(order[k] for k in g)
                if image not in group:
                    group[image] = sign * s
                    frontier.append((image, sign * s))
        images = F.explode(F.array(*[F.struct(*[d(o).alias(f"e{k}") for k, o in enumerate(order)], (v() * float(sign)).alias("w")) for order, sign in sorted(group.items())])).alias("t")
        df = self.df.select(images).select(*[F.col(f"t.e{k}").alias(f"d{k}") for k in range(self.rank)], F.col("t.w").alias("v"))
        return Tensor(df.groupBy(*self.names).agg(F.max("v").alias("v")), self.dims)

    def cast(self, kind: str) -> Tensor:
        return self.map(lambda x: x.cast(kind))

    def eval(self) -> Tensor:
        """The tensor written and read again: its plan ends here (a reliable checkpoint)."""
        return Tensor(cut(self.df), self.dims)

    @staticmethod
    def random(spark: SparkSession, dims: Sequence[int], seed: int = 0, normal: bool = False) -> Tensor:
        """Uniform in [0, 1), or standard normal."""
        return Tensor.generate(spark, dims, lambda *_: F.randn(seed) if normal else F.rand(seed))

    def symmetrized(self, a: int, b: int, sign: int = 1) -> Tensor:
        """Each stored entry and its mirror in dimensions a and b (sign -1: antisymmetric)."""
        order = list(range(self.rank))
        order[a], order[b] = order[b], order[a]
        mirrored = self.shuffle(order).map(lambda x: x * sign).df.where(d(a) != d(b))
        return Tensor(self.df.unionByName(mirrored), self.dims)

    # ---- reductions

    def _kept(self, over: Sequence[int] | None) -> list[int]:
        return [] if over is None else [k for k in range(self.rank) if k not in over]

    def reduce(self, out: Column, over: Sequence[int] | None = None) -> Tensor | DataFrame:
        """An aggregate of v over some dimensions (None: all, giving a one-row DataFrame)."""
        kept = self._kept(over)
        if not kept:
            return self.df.agg(out.alias("v"))
        df = self.df.groupBy(*[f"d{k}" for k in kept]).agg(out.alias("v"))
        return Tensor(df.select(*[d(k).alias(f"d{n}") for n, k in enumerate(kept)], "v"), tuple(self.dims[k] for k in kept))

    def reduce_with(self, reducer: Reducer, over: Sequence[int] | None = None) -> Tensor | DataFrame:
        """A user's reducer over some dimensions (None: all); structural zeros go to reducer.zeros where it has that."""
        kept = self._kept(over)
        df = reduced(self.df, [f"d{k}" for k in kept], reducer, self._size(over) if hasattr(reducer, "zeros") else None)
        return Tensor(df.select(*[d(k).alias(f"d{n}") for n, k in enumerate(kept)], "v"), tuple(self.dims[k] for k in kept)) if kept else df

    def sum(self, over: Sequence[int] | None = None):
        return self.reduce(F.coalesce(F.sum("v"), F.lit(0.0)), over)

    def _size(self, over: Sequence[int] | None) -> int:
        return prod(self.dims if over is None else [self.dims[k] for k in over])

    def mean(self, over: Sequence[int] | None = None):
        n = self._size(over)
        return self.reduce(F.coalesce(F.sum("v"), F.lit(0.0)) / F.lit(float(n) if n else float("nan")), over)

    def prod(self, over: Sequence[int] | None = None):
        return self.reduce(F.when(F.count("v") == self._size(over), F.coalesce(F.product("v"), F.lit(1.0))).otherwise(F.lit(0.0)), over)

    def maximum(self, over: Sequence[int] | None = None):
        """Missing entries count as 0; an empty tensor has -inf."""
        return self.reduce(F.coalesce(F.when(F.count("v") == self._size(over), F.max("v")).otherwise(F.greatest(F.max("v"), F.lit(0.0))), F.lit(float("-inf"))), over)

    def minimum(self, over: Sequence[int] | None = None):
        return self.reduce(F.coalesce(F.when(F.count("v") == self._size(over), F.min("v")).otherwise(F.least(F.min("v"), F.lit(0.0))), F.lit(float("inf"))), over)

    def all(self, over: Sequence[int] | None = None):
        return self.reduce((F.count("v") == self._size(over)) & F.coalesce(F.bool_and(v() != 0), F.lit(True)), over)

    def any(self, over: Sequence[int] | None = None):
        return self.reduce(F.coalesce(F.bool_or(v() != 0), F.lit(False)), over)

    def arg_extreme(self, dim: int | None = None, largest: bool = True, layout: str = "col"):
        """The linear index (dim None) or the index along dim of the extreme stored value; ties: the smallest."""
        at = self.linear(layout) if dim is None else d(dim)
        best = F.min(F.struct((-v() if largest else v()).alias("k"), at.alias("at")))["at"]
        return self.reduce(best, None if dim is None else [dim])

    def trace(self, dims: Sequence[int]) -> Tensor | DataFrame:
        test = F.lit(True)
        for k in dims[1:]:
            test = test & (d(k) == d(dims[0]))
        kept = self._kept(dims)
        return Tensor(self.df.where(test), self.dims).reduce(F.coalesce(F.sum("v"), F.lit(0.0)), list(dims) if kept else None)

    # ---- scans and windows

    def _others(self, axis: int) -> list[str]:
        return [f"d{k}" for k in range(self.rank) if k != axis]

    def scan(self, axis: int, out: Callable[[Column], Column], exclusive: bool = False, start: float = 0.0) -> Tensor:
        """A running aggregate along axis over stored entries; a line of this general form is one window."""
        w = Window.partitionBy(*self._others(axis)).orderBy(f"d{axis}").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        return Tensor(self.df.withColumn("v", F.coalesce(out(v()).over(w), F.lit(float(start)))), self.dims)

    def _running(self, axis: int, of: Callable[[Column], Column], combine: Callable[[Column, Column], Column], unit: float, block: int) -> DataFrame:
        """(dimensions, v, prior, n, next): running values over stored entries with and without the own one, their number so far, and the next stored place.

        Two levels: lines are cut into blocks of `block` places, each block has its total, the
        totals of earlier blocks are combined, and windows run within blocks only. So a line of
        any length is many tasks.
        """
        at, others = f"d{axis}", self._others(axis)
        if self.dims[axis] <= block:
            w = Window.partitionBy(*others).orderBy(at)
            return self.df.select(*self.names, of(v()).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("v"), F.coalesce(of(v()).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(unit)).alias("prior"), F.row_number().over(w).cast("long").alias("n"), F.lead(at).over(w).alias("next"))
        cut = self.df.withColumn("_b", F.floor(F.col(at) / block).cast("long"))
        totals = cut.groupBy(*others, "_b").agg(of(v()).alias("_t"), F.count("*").alias("_c"), F.min(at).alias("_first"))
        before = Window.partitionBy(*others).orderBy("_b")
        earlier = before.rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(*others, "_b", F.coalesce(of(F.col("_t")).over(earlier), F.lit(unit)).alias("_before"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_n"), F.lead("_first").over(before).alias("_after"))
        inner = Window.partitionBy(*others, "_b").orderBy(at)
        df = cut.select(*self.names, "_b", of(v()).over(inner.rowsBetween(Window.unboundedPreceding, 0)).alias("_v"), F.coalesce(of(v()).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(unit)).alias("_p"), F.row_number().over(inner).alias("_k"), F.lead(at).over(inner).alias("_next"))
        df = df.join(totals, [*others, "_b"])
        return df.select(*self.names, combine(F.col("_before"), F.col("_v")).alias("v"), combine(F.col("_before"), F.col("_p")).alias("prior"), (F.col("_k") + F.col("_n")).cast("long").alias("n"), F.coalesce("_next", "_after").alias("next"))

    def cumsum(self, axis: int, exclusive: bool = False, stored: bool = False, block: int = SCAN_BLOCK) -> Tensor:
        """Running sums along axis. Missing places are zeros and get the sum so far; with stored, only stored places are kept (and read)."""
        at = f"d{axis}"
        run = self._running(axis, F.sum, lambda a, b: a + b, 0.0, block)
        if stored:
            return Tensor(run.select(*self.names, F.col("prior" if exclusive else "v").alias("v")), self.dims)
        if prod(self.dims) > DENSE_CELLS:
            raise ValueError("running sums fill their lines: give the true extents, or stored=True")
        shift = 1 if exclusive else 0
        last = F.least(F.coalesce("next", F.lit(self.dims[axis])) - 1 + shift, F.lit(self.dims[axis] - 1))
        first = F.col(at) + shift
        df = run.withColumn(at, F.explode(F.when(first <= last, F.sequence(first, last))).alias(at))
        return Tensor(df.select(*[F.col(c).cast("long").alias(c) for c in self.names], "v"), self.dims)

    def cumprod(self, axis: int, exclusive: bool = False, stored: bool = False, block: int = SCAN_BLOCK) -> Tensor:
        """Running products along axis. A missing place is a zero, so products end (and go missing) there; with stored, missing places are passed over."""
        at = f"d{axis}"
        run = self._running(axis, F.product, lambda a, b: a * b, 1.0, block)
        if stored:
            return Tensor(run.select(*self.names, F.col("prior" if exclusive else "v").alias("v")), self.dims)
        df = run.where(F.col("n") - 1 == F.col(at)).select(*self.names, "v")  # nothing is missing before it
        if not exclusive:
            return Tensor(df, self.dims)
        moved = df.withColumn(at, F.col(at) + 1).where(F.col(at) < self.dims[axis])
        others = [k for k in range(self.rank) if k != axis]
        lines = Tensor.generate(self.df.sparkSession, [self.dims[k] for k in others], lambda *_: F.lit(1.0)).df
        first = lines.select(*[d(n).alias(f"d{k}") for n, k in enumerate(others)], F.lit(0).cast("long").alias(at), "v")
        return Tensor(moved.unionByName(first), self.dims)

    def convolve(self, kernel: Sequence, dims: Sequence[int]) -> Tensor:
        """Valid correlation with a (nested list) kernel over dims: each entry meets its kernel cells, then one aggregate."""
        cells: list[tuple[tuple[int, ...], float]] = []

        def walk(part, at):
            for k, x in enumerate(part):
                walk(x, (*at, k)) if isinstance(x, (list, tuple)) else cells.append(((*at, k), float(x)))

        walk(kernel, ())
        extent = [max(c[0][n] for c in cells) + 1 for n in range(len(dims))]
        arms = F.explode(F.array(*[F.struct(*[F.lit(o).alias(f"o{n}") for n, o in enumerate(at)], F.lit(x).alias("w")) for at, x in cells])).alias("c")
        df = self.df.select("*", arms)
        index, test, out = [], F.lit(True), list(self.dims)
        for k in range(self.rank):
            if k in dims:
                n = list(dims).index(k)
                out[k] = self.dims[k] - extent[n] + 1
                index.append(d(k) - F.col(f"c.o{n}"))
                test = test & (index[-1] >= 0) & (index[-1] < out[k])
            else:
                index.append(d(k))
        moved = df.where(test).select(*[x.cast("long").alias(f"d{k}") for k, x in enumerate(index)], (v() * F.col("c.w")).alias("v"))
        return Tensor(moved.groupBy(*self.names).agg(F.sum("v").alias("v")), tuple(out))

    def patches(self, size: Sequence[int], stride: Sequence[int] | None = None, dilation: Sequence[int] | None = None, padding: str = "valid") -> Tensor:
        """All patches; the patch number is the last dimension (column-major over patch places). With padding "same", patches reach over the edges into zeros."""
        stride, dilation = stride or [1] * self.rank, dilation or [1] * self.rank
        reach = [(n - 1) * r + 1 for n, r in zip(size, dilation)]
        if padding == "same":
            places = [-(-n // t) for n, t in zip(self.dims, stride)]
            before = [max(0, (p - 1) * t + r - n) // 2 for p, t, r, n in zip(places, stride, reach, self.dims)]
        else:
            places, before = [(n - r) // t + 1 for n, r, t in zip(self.dims, reach, stride)], [0] * self.rank
        df = self.df
        for k, n in enumerate(size):
            df = df.withColumn(f"o{k}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        number, step, test = F.lit(0).cast("long"), 1, F.lit(True)
        for k, n in enumerate(places):
            at = d(k) + before[k] - F.col(f"o{k}") * dilation[k]
            test = test & (at >= 0) & (at % stride[k] == 0) & (at < n * stride[k])
            number, step = number + F.floor(at / stride[k]) * step, step * n
        df = df.where(test).select(*[F.col(f"o{k}").cast("long").alias(f"d{k}") for k in range(self.rank)], number.cast("long").alias(f"d{self.rank}"), "v")
        return Tensor(df, (*size, step))

    def image_patches(self, dims: tuple[int, int], size: tuple[int, int], stride: tuple[int, int] = (1, 1), dilation: tuple[int, int] = (1, 1), padding: str = "valid", pad_value: float = 0.0, inflation: tuple[int, int] = (1, 1)) -> Tensor:
        """Patches of two dimensions with strides and dilation; "same" pads with pad_value, inflation sets zeros between the input's places first. New dimensions (row in patch, column in patch, patch) come last."""
        if inflation != (1, 1):
            steps = [1] * self.rank
            steps[dims[0]], steps[dims[1]] = inflation
            return self.inflate(steps).image_patches(dims, size, stride, dilation, padding, pad_value)
        places, before = [], []
        for k, s, t, r in zip(dims, size, stride, dilation):
            reach = (s - 1) * r + 1
            if padding == "same":
                n = -(-self.dims[k] // t)
                places.append(n)
                before.append(max(0, (n - 1) * t + reach - self.dims[k]) // 2)
            else:
                places.append((self.dims[k] - reach) // t + 1)
                before.append(0)
        rest = [k for k in range(self.rank) if k not in dims]
        grid = Tensor.generate(self.df.sparkSession, (*size, *places), lambda *_: F.lit(0.0)).df.drop("v").toDF("p", "q", "x", "y")
        cells = grid.select("p", "q", (F.col("x") + F.col("y") * places[0]).alias("n"), (F.col("x") * stride[0] + F.col("p") * dilation[0] - before[0]).alias("_a"), (F.col("y") * stride[1] + F.col("q") * dilation[1] - before[1]).alias("_b"))
        a, b = (f"d{k}" for k in dims)
        index = [f"d{k}" for k in rest] + ["p", "q", "n"]
        inside = self.df.join(bounded(cells, prod(size) * prod(places)), (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b"))).select(*index, "v")
        out = [self.dims[k] for k in rest] + [*size, prod(places)]
        if padding == "same" and pad_value != 0:
            outside = cells.where((F.col("_a") < 0) | (F.col("_a") >= self.dims[dims[0]]) | (F.col("_b") < 0) | (F.col("_b") >= self.dims[dims[1]]))
            for k in rest:
                outside = outside.withColumn(f"d{k}", F.explode(F.sequence(F.lit(0), F.lit(self.dims[k] - 1))).cast("long"))
            inside = inside.unionByName(outside.select(*index, F.lit(float(pad_value)).alias("v")))
        return Tensor(inside.toDF(*[f"d{k}" for k in range(len(out))], "v"), tuple(out))

    def volume_patches(self, size: Sequence[int], stride: Sequence[int] = (1, 1, 1), padding: str = "valid") -> Tensor:
        """Patches over the first three dimensions."""
        more = self.rank - 3
        return self.patches([*size, *[1] * more], [*stride, *[1] * more], None, padding)

    # ---- products

    def contract(self, other: Tensor, pairs: Sequence[tuple[int, int]], kernel: Callable[[Column], Column] | None = None) -> Tensor | DataFrame:
        """Sum over paired dimensions (of this, of other); the free ones of this come first. `kernel` is applied to the sums."""
        a = self.df.select(*[d(k).alias(f"a{k}") for k in range(self.rank)], v().alias("av"))
        b = other.df.select(*[d(k).alias(f"b{k}") for k in range(other.rank)], v().alias("bv"))
        if prod(other.dims) <= 500_000:
            b = F.broadcast(b)
        test = F.lit(True)
        for p, q in pairs:
            test = test & (F.col(f"a{p}") == F.col(f"b{q}"))
        free = [(f"a{k}", self.dims[k]) for k in range(self.rank) if k not in [p for p, _ in pairs]] + [(f"b{k}", other.dims[k]) for k in range(other.rank) if k not in [q for _, q in pairs]]
        joined = a.join(b, test) if pairs else a.crossJoin(bounded(b, prod(other.dims)))
        total = F.sum(F.col("av") * F.col("bv"))
        out = kernel(total) if kernel else total
        if not free:
            return joined.agg(F.coalesce(out, F.lit(0.0)).alias("v"))
        df = joined.groupBy(*[n for n, _ in free]).agg(out.alias("v"))
        return Tensor(df.toDF(*[f"d{k}" for k in range(len(free))], "v"), tuple(n for _, n in free))

    def fft(self, dims: Sequence[int], inverse: bool = False, part: str = "both", scaled: bool = True, half: bool = False, line: int = FFT_LINE) -> Tensor | DataFrame:
        """Discrete Fourier transform along dims, one dimension at a time (inverse scaled by 1/n unless not scaled).

        A line of up to `line` places is one Arrow group. A longer one of n = p q places is
        transformed in four steps: q lines of p, twiddle factors, p lines of q; its extent must
        have such a divisor. With half, only the first n // 2 + 1 places of the first dimension in dims
        come back (the rest of a real tensor's spectrum mirrors them). The result has columns re
        and im, or with part="real" or "imag" is a tensor.
        """
        df = self.df.select(*self.names, v().cast("double").alias("re"), F.lit(0.0).alias("im"))
        for axis in dims:
            n, name = self.dims[axis], f"d{axis}"
            keys = self._others(axis)
            if n <= line:
                df = _fft_lines(df, self.names, keys, name, n, inverse)
            else:
                p = next((p for p in range(math.isqrt(n), 1, -1) if n % p == 0), 1)
                if p == 1 or n // p > line:
                    raise ValueError(f"a line of {n} places has no divisors that make short lines")
                q = n // p
                split = [*self.names, "_r"]
                # place = r + q c: for each r a transform over c, then for each of its places one over r
                df = df.select(*keys, (F.col(name) % q).alias("_r"), F.floor(F.col(name) / q).cast("long").alias(name), "re", "im")
                df = _fft_lines(df, split, [*keys, "_r"], name, p, inverse)
                turn = F.lit((2.0 if inverse else -2.0) * math.pi / n) * F.col("_r") * F.col(name)
                df = df.withColumn("_t", turn).select(*keys, name, "_r", (F.col("re") * F.cos("_t") - F.col("im") * F.sin("_t")).alias("re"), (F.col("re") * F.sin("_t") + F.col("im") * F.cos("_t")).alias("im"))
                df = _fft_lines(df, split, [*keys, name], "_r", q, inverse)
                df = df.select(*keys, (F.col(name) + F.col("_r") * p).alias(name), "re", "im").select(*self.names, "re", "im")
            if inverse and not scaled:
                df = df.withColumns({"re": F.col("re") * n, "im": F.col("im") * n})
        extents = list(self.dims)
        if half:
            extents[dims[0]] = self.dims[dims[0]] // 2 + 1
            df = df.where(d(dims[0]) < extents[dims[0]])
        if part == "both":
            return df
        return Tensor(df.select(*self.names, F.col({"real": "re", "imag": "im"}[part]).alias("v")), tuple(extents))

    def custom(self, f: Callable[[DataFrame], DataFrame], dims: Sequence[int]) -> Tensor:
        """A user's operation on the relation, with the extents of its result."""
        return Tensor(f(self.df), tuple(dims))

    def formatted(self, digits: int = 6, separator: str = " ", row_separator: str = "\n", prefix: str = "", suffix: str = "") -> DataFrame:
        """Printed slices (the leading dimensions, text): a tensor's last two dimensions as rows and columns; a missing place is a zero."""
        if self.rank < 2:
            return self.df.agg(F.sort_array(F.collect_list(F.struct(*self.names, "v"))).alias("a")).select(F.concat(F.lit(prefix), F.array_join(F.transform("a", lambda x: F.format_number(x["v"], digits)), separator), F.lit(suffix)).alias("text"))
        rows, cols = self.dims[-2:]
        lead = self.names[:-2]
        cells = self.df.groupBy(*lead).agg(F.map_from_entries(F.collect_list(F.struct((d(self.rank - 2) * cols + d(self.rank - 1)).alias("k"), "v"))).alias("m"))
        cell = lambda r, c: F.format_number(F.coalesce(F.try_element_at("m", (r * cols + c).cast("long")), F.lit(0.0)), digits)
        line = lambda r: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: cell(r, c)), separator)
        text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), line), row_separator)
        return cells.select(*lead, F.concat(F.lit(prefix), text, F.lit(suffix)).alias("text"))
