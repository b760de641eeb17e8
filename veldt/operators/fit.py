"""Nonlinear least squares and root finding: driver loops whose sums over the data are one aggregate an iteration."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.operators import kernels as K


def numerical_jacobian(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, central: bool = False) -> np.ndarray:
    eps = np.sqrt(K.EPS) if not central else np.cbrt(K.EPS)
    base = f(x)
    out = np.zeros((len(base), len(x)))
    for k in range(len(x)):
        h = eps * max(abs(x[k]), 1.0)
        up = x.copy()
        up[k] += h
        if central:
            down = x.copy()
            down[k] -= h
            out[:, k] = (f(up) - f(down)) / (2 * h)
        else:
            out[:, k] = (f(up) - base) / h
    return out


def levenberg_marquardt(data: DataFrame, residual: Callable[[list[Column]], Column], start: list[float], max_iterations: int = 100, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray, float]:
    """(parameters, covariance, squared residual): minimise the sum of residual(parameters)**2 over the rows.

    Derivatives are central differences of the residual's Column expression; J^T J and
    J^T r of all rows come from one aggregate of n * (n + 3) / 2 sums.
    """
    data = data.persist()
    n, x = len(start), np.array(start, float)

    def lits(p: np.ndarray) -> list[Column]:
        return [F.lit(float(v)) for v in p]

    def cost(p: np.ndarray) -> float:
        return data.agg(F.sum(F.pow(residual(lits(p)), F.lit(2.0)))).first()[0] or 0.0

    def normal(p: np.ndarray):
        columns = [residual(lits(p)).alias("r")]
        for k in range(n):
            h = np.cbrt(K.EPS) * max(abs(p[k]), 1.0)
            up, down = p.copy(), p.copy()
            up[k] += h
            down[k] -= h
            columns.append(((residual(lits(up)) - residual(lits(down))) / (2 * h)).alias(f"g{k}"))
        df = data.select(*columns)
        sums = [F.sum(F.col(f"g{a}") * F.col(f"g{b}")).alias(f"h{a}_{b}") for a in range(n) for b in range(a + 1)]
        sums += [F.sum(F.col(f"g{a}") * F.col("r")).alias(f"v{a}") for a in range(n)]
        row = df.agg(*sums).first().asDict()
        h = np.zeros((n, n))
        for a in range(n):
            for b in range(a + 1):
                h[a, b] = h[b, a] = row[f"h{a}_{b}"]
        return h, np.array([row[f"v{a}"] for a in range(n)])

    now, damping = cost(x), 1e-3
    h, g = normal(x)
    for _ in range(max_iterations):
        step = np.linalg.solve(h + damping * np.diag(np.maximum(np.diag(h), 1e-30)), -g)
        then = cost(x + step)
        if then < now:
            small = now - then <= tolerance * max(now, 1e-300) and np.linalg.norm(step) <= 1e-6 * (np.linalg.norm(x) + 1e-6)
            x, now, damping = x + step, then, max(damping / 10, 1e-15)
            if small or now == 0:
                break
            h, g = normal(x)
        else:
            damping *= 10
            if damping > 1e12:
                break
    covariance = np.linalg.pinv(normal(x)[0])
    return x, covariance, now


def hybrid_root(f: Callable[[np.ndarray], np.ndarray], start: list[float], max_iterations: int = 200, tolerance: float = 1e-12) -> np.ndarray:
    """A root of a square system by Powell's dogleg with Broyden updates."""
    x = np.array(start, float)
    r = f(x)
    jac = numerical_jacobian(f, x)
    radius, fresh = max(1.0, np.linalg.norm(x)), True
    for _ in range(max_iterations):
        if np.abs(r).max() <= tolerance:
            break
        newton = np.linalg.lstsq(jac, -r, rcond=None)[0]
        g = -(jac.T @ r)
        cauchy = g * (g @ g) / max(np.linalg.norm(jac @ g) ** 2, 1e-300)
        if np.linalg.norm(newton) <= radius:
            step = newton
        elif np.linalg.norm(cauchy) >= radius:
            step = g / np.linalg.norm(g) * radius
        else:
            d = newton - cauchy
            a, b, c = d @ d, 2 * cauchy @ d, cauchy @ cauchy - radius**2
            step = cauchy + (-b + np.sqrt(b * b - 4 * a * c)) / (2 * a) * d
        then = f(x + step)
        expected = np.linalg.norm(r) - np.linalg.norm(r + jac @ step)
        ratio = (np.linalg.norm(r) - np.linalg.norm(then)) / max(expected, 1e-300)
        jac_step = jac @ step
        if ratio > 1e-4:
            x = x + step
            jac = jac + np.outer(then - r - jac_step, step) / (step @ step)
            r, fresh = then, False
            radius = max(radius, 2 * np.linalg.norm(step)) if ratio > 0.5 else radius
        elif not fresh:
            jac, fresh = numerical_jacobian(f, x), True
        else:
            radius /= 4
            if radius < 1e-15:
                break
    return x


class Dual:
    """Forward-mode derivatives of Columns: a value and its gradient, one Column per variable."""

    def __init__(self, value: Column, grad: list[Column]):
        self.value, self.grad = value, grad

    @staticmethod
    def variables(*columns: Column) -> list[Dual]:
        n = len(columns)
        return [Dual(c, [F.lit(1.0 if k == m else 0.0) for m in range(n)]) for k, c in enumerate(columns)]

    @staticmethod
    def _of(x, n: int) -> Dual:
        return x if isinstance(x, Dual) else Dual(x if isinstance(x, Column) else F.lit(float(x)), [F.lit(0.0)] * n)

    def _chain(self, value: Column, slope: Column) -> Dual:
        return Dual(value, [slope * g for g in self.grad])

    def __add__(self, other):
        o = Dual._of(other, len(self.grad))
        return Dual(self.value + o.value, [a + b for a, b in zip(self.grad, o.grad)])

    __radd__ = __add__

    def __neg__(self):
        return Dual(-self.value, [-g for g in self.grad])

    def __sub__(self, other):
        return self + (-Dual._of(other, len(self.grad)))

    def __rsub__(self, other):
        return (-self) + other

    def __mul__(self, other):
        o = Dual._of(other, len(self.grad))
        return Dual(self.value * o.value, [a * o.value + self.value * b for a, b in zip(self.grad, o.grad)])

    __rmul__ = __mul__

    def __truediv__(self, other):
        o = Dual._of(other, len(self.grad))
        return Dual(self.value / o.value, [(a * o.value - self.value * b) / (o.value * o.value) for a, b in zip(self.grad, o.grad)])

    def exp(self):
        return self._chain(F.exp(self.value), F.exp(self.value))

    def log(self):
        return self._chain(F.log(self.value), 1 / self.value)

    def sin(self):
        return self._chain(F.sin(self.value), F.cos(self.value))

    def cos(self):
        return self._chain(F.cos(self.value), -F.sin(self.value))

    def sqrt(self):
        return self._chain(F.sqrt(self.value), 0.5 / F.sqrt(self.value))

    def pow(self, p: float):
        return self._chain(F.pow(self.value, F.lit(float(p))), p * F.pow(self.value, F.lit(float(p - 1))))

    def column(self) -> Column:
        return F.struct(self.value.alias("val"), F.array(*self.grad).alias("grad"))


def umeyama(pairs: DataFrame, source: list[str], target: list[str], scaling: bool = True) -> np.ndarray:
    """The similarity that maps source coordinates to target coordinates best; moments by one aggregate, a small SVD on the driver."""
    n = F.count("*").alias("n")
    means = [F.avg(c).alias(f"m_{c}") for c in [*source, *target]]
    products = [F.avg(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a in target for b in source]
    squares = [F.avg(F.col(a) * F.col(a)).alias(f"q_{a}") for a in source]
    row = pairs.agg(n, *means, *products, *squares).first().asDict()
    ms, mt = (np.array([row[f"m_{c}"] for c in names]) for names in (source, target))
    cov = np.array([[row[f"p_{a}_{b}"] for b in source] for a in target]) - np.outer(mt, ms)
    var = sum(row[f"q_{a}"] for a in source) - ms @ ms
    return K.umeyama_moments(row["n"], ms, mt, cov, var if var > 1e-14 * (1 + ms @ ms) else 0.0, scaling)
