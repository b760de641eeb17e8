"""Iterative solvers: the only distributed step is a sparse matrix-vector product.

Two forms. With the iterates on the driver (at most MAX_DRIVER_VECTOR entries, checked),
each product is one job over the cached triplets with the vector broadcast; all Krylov
methods share that form. Beyond it, `conjugate_gradient_distributed` keeps vectors as
DataFrames too, with written checkpoints. Tolerances are relative to |b|; by default the
machine epsilon; at most 2 * cols iterations; b = 0 gives x = 0 after no iteration.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.operators import sparse_direct
from veldt.operators.lineage import cut
from veldt.operators.matrix import Matrix

MAX_DRIVER_VECTOR = 10_000_000
EPS = np.finfo(float).eps
Apply = Callable[[np.ndarray], np.ndarray]


@dataclass
class Solution:
    x: np.ndarray
    iterations: int
    error: float
    converged: bool


class Operator:
    """y = A x and y = A^T x over cached triplets; a matrix-free operator gives its own functions."""

    def __init__(self, m: Matrix | None = None, apply: Apply | None = None, transposed: Apply | None = None):
        self.m = m
        if m is not None:
            if max(m.rows, m.cols) > MAX_DRIVER_VECTOR:
                raise ValueError("the vectors are too long for the driver; use conjugate_gradient_distributed")
            self.df = m.df.select("i", "j", F.col("v").cast("double").alias("v")).persist()
        self.apply = apply or self._product(False)
        self.transposed = transposed or self._product(True)

    def _product(self, transpose: bool) -> Apply:
        def run(x: np.ndarray) -> np.ndarray:
            out_i, in_j = ("j", "i") if transpose else ("i", "j")
            held = self.df.sparkSession.sparkContext.broadcast(x)

            def local(frames):
                for pdf in frames:
                    y = pdf["v"].to_numpy() * held.value[pdf[in_j].to_numpy()]
                    keys, at = np.unique(pdf[out_i].to_numpy(), return_inverse=True)
                    yield pd.DataFrame({"k": keys, "y": np.bincount(at, y, len(keys))})

            got = self.df.mapInPandas(local, "k long, y double").groupBy("k").agg(F.sum("y").alias("y")).toPandas()
            out = np.zeros(self.m.cols if transpose else self.m.rows)
            out[got["k"].to_numpy()] = got["y"].to_numpy()
            held.destroy()
            return out

        return run

    def columns(self) -> sparse_direct.Columns:
        """The matrix as sparse columns on the driver (bounded, see sparse_direct), for preconditioners."""
        return sparse_direct.gathered(self.m)

    def close(self) -> None:
        """Release the cached triplets."""
        if self.m is not None:
            self.df.unpersist()

    def __enter__(self) -> Operator:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def diagonal(self) -> np.ndarray:
        got = self.df.where("i = j").toPandas()
        out = np.zeros(self.m.rows)
        out[got["i"].to_numpy()] = got["v"].to_numpy()
        return out

    def column_squares(self) -> np.ndarray:
        got = self.df.groupBy("j").agg(F.sum(F.col("v") * F.col("v")).alias("s")).toPandas()
        out = np.zeros(self.m.cols)
        out[got["j"].to_numpy()] = got["s"].to_numpy()
        return out


def jacobi(diagonal: np.ndarray) -> Apply:
    """Diagonal preconditioner; zeros act as 1."""
    inverse = 1 / np.where(diagonal == 0, 1.0, diagonal)
    return lambda r: inverse * r


def incomplete_lu(a, drop: float = 1e-4, fill: int = 10) -> Apply:
    """Incomplete LU with threshold of sparse columns (or a dense array)."""
    return sparse_direct.incomplete_lut(a if isinstance(a, sparse_direct.Columns) else sparse_direct.Columns.of_dense(a), drop, fill)


def incomplete_cholesky(a, shift: float = 1e-3) -> Apply:
    """Incomplete Cholesky of sparse columns (or a dense array), without fill."""
    return sparse_direct.incomplete_cholesky(a if isinstance(a, sparse_direct.Columns) else sparse_direct.Columns.of_dense(a), shift)


def least_squares_diagonal(op: Operator) -> Apply:
    """Diagonal preconditioner of A^T A."""
    return jacobi(op.column_squares())


def _start(b: np.ndarray, guess: np.ndarray | None, tolerance: float | None, limit: int | None, cols: int):
    x = np.zeros(cols) if guess is None else np.array(guess, float)
    size = float(np.linalg.norm(b))
    return x, size, max((EPS if tolerance is None else tolerance) * size, np.finfo(float).tiny), 2 * cols if limit is None else limit


def conjugate_gradient(a: Apply, b: np.ndarray, preconditioner: Apply = lambda r: r, guess=None, tolerance=None, max_iterations=None) -> Solution:
    x, size, goal, limit = _start(b, guess, tolerance, max_iterations, len(b))
    if size == 0:
        return Solution(np.zeros_like(x), 0, 0.0, True)
    r = b - a(x) if guess is not None else b.astype(float).copy()
    z = preconditioner(r)
    p, rz, k = z.copy(), r @ z, 0
    while np.linalg.norm(r) > goal and k < limit:
        q = a(p)
        step = rz / (p @ q)
        x, r = x + step * p, r - step * q
        z = preconditioner(r)
        rz, old = r @ z, rz
        p, k = z + rz / old * p, k + 1
    error = float(np.linalg.norm(r)) / size
    return Solution(x, k, error, error * size <= goal)


def bicgstab(a: Apply, b: np.ndarray, preconditioner: Apply = lambda r: r, guess=None, tolerance=None, max_iterations=None) -> Solution:
    return bicgstab_l(a, b, 1, preconditioner, guess, tolerance, max_iterations)


def bicgstab_l(a: Apply, b: np.ndarray, ell: int = 2, preconditioner: Apply = lambda r: r, guess=None, tolerance=None, max_iterations=None) -> Solution:
    """BiCGSTAB(L): L bi-conjugate steps, then a minimal-residual polynomial of degree L. Preconditioned from the right."""
    y, size, goal, limit = _start(b, None, tolerance, max_iterations, len(b))
    if size == 0:
        return Solution(y, 0, 0.0, True)
    x0 = np.zeros(len(b)) if guess is None else np.array(guess, float)
    op = lambda w: a(preconditioner(w))
    r = [b - a(x0) if guess is not None else b.astype(float).copy()]
    shadow, u = r[0].copy(), [np.zeros(len(b))]
    rho, alpha, omega, k = 1.0, 0.0, 1.0, 0
    while np.linalg.norm(r[0]) > goal and k < limit:
        rho *= -omega
        r, u = r[:1], u[:1]
        for n in range(ell):
            rho1 = r[n] @ shadow
            if rho == 0 or abs(rho1) < EPS**2 * (shadow @ shadow):
                shadow = r[0].copy()
                u = [np.zeros(len(b)) for _ in u]
                rho1, beta = r[n] @ shadow, 0.0
            else:
                beta = alpha * rho1 / rho
            rho = rho1
            u = [r[m] - beta * u[m] for m in range(n + 1)]
            u.append(op(u[n]))
            alpha = rho / (u[n + 1] @ shadow)
            r = [r[m] - alpha * u[m + 1] for m in range(n + 1)]
            y = y + alpha * u[0]
            if np.linalg.norm(r[0]) <= goal:  # nothing is left to stabilise
                break
            r.append(op(r[n]))
        if np.linalg.norm(r[0]) <= goal:
            k += 1
            break
        basis = np.array(r[1:]).T
        gamma = np.linalg.lstsq(basis, r[0], rcond=None)[0]
        y = y + np.array(r[:-1]).T @ gamma
        u[0] = u[0] - np.array(u[1:]).T @ gamma
        r[0] = r[0] - basis @ gamma
        omega, k = gamma[-1], k + 1
    error = float(np.linalg.norm(r[0])) / size
    return Solution(x0 + preconditioner(y), k, error, error * size <= goal)


def gmres(a: Apply, b: np.ndarray, restart: int = 30, preconditioner: Apply = lambda r: r, guess=None, tolerance=None, max_iterations=None, deflate: int = 0) -> Solution:
    """Restarted GMRES; with deflate, that many approximate eigenvectors of smallest value augment each restart."""
    x, size, goal, limit = _start(b, guess, tolerance, max_iterations, len(b))
    if size == 0:
        return Solution(np.zeros_like(x), 0, 0.0, True)
    kept = np.zeros((len(b), 0))
    r, k = b - a(x) if guess is not None else b.astype(float).copy(), 0
    while np.linalg.norm(r) > goal and k < limit:
        beta = np.linalg.norm(r)
        basis, directions = [r / beta], []
        steps = min(restart, len(b))
        h = np.zeros((steps + kept.shape[1] + 1, steps + kept.shape[1]))
        for n in range(steps + kept.shape[1]):
            d = basis[n] if n < steps else kept[:, n - steps]
            z = preconditioner(d)
            w = a(z)
            directions.append(z)
            for _ in range(2):
                for m, q in enumerate(basis):
                    c = q @ w
                    h[m, n] += c
                    w = w - c * q
            h[n + 1, n] = np.linalg.norm(w)
            k += 1
            done = h[n + 1, n] <= EPS * beta
            basis.append(w / h[n + 1, n] if not done else np.zeros_like(w))
            e = np.zeros(n + 2)
            e[0] = beta
            y = np.linalg.lstsq(h[: n + 2, : n + 1], e, rcond=None)[0]
            if done or np.linalg.norm(e - h[: n + 2, : n + 1] @ y) <= goal or k >= limit:
                break
        x = x + np.array(directions).T @ y
        if deflate and len(directions) <= steps:
            n = len(directions)
            w, s = np.linalg.eig(h[:n, :n])
            s = s[:, np.argsort(np.abs(w))[:deflate]]
            kept = np.linalg.qr(np.array(basis[:n]).T @ s.real)[0]
        old, r = np.linalg.norm(r), b - a(x)
        if np.linalg.norm(r) >= old * (1 - 1e-14):
            break
    error = float(np.linalg.norm(r)) / size
    return Solution(x, k, error, error * size <= goal)


def dgmres(a: Apply, b: np.ndarray, restart: int = 30, deflate: int = 2, **how) -> Solution:
    return gmres(a, b, restart, deflate=deflate, **how)


def minres(a: Apply, b: np.ndarray, guess=None, tolerance=None, max_iterations=None) -> Solution:
    """For symmetric, also indefinite, systems: Lanczos with a running QR."""
    x, size, goal, limit = _start(b, guess, tolerance, max_iterations, len(b))
    if size == 0:
        return Solution(np.zeros_like(x), 0, 0.0, True)
    r = b - a(x) if guess is not None else b.astype(float).copy()
    beta = np.linalg.norm(r)
    v_old, v = np.zeros_like(r), r / beta if beta else r
    eta, c_old, c, s_old, s = beta, 1.0, 1.0, 0.0, 0.0
    d_old, d = np.zeros_like(r), np.zeros_like(r)
    next_beta, k, left = 0.0, 0, beta
    while left > goal and k < limit:
        w = a(v) - next_beta * v_old
        alpha = v @ w
        w = w - alpha * v
        new_beta = np.linalg.norm(w)
        r3, r2, r1 = s_old * next_beta, c_old * s * next_beta + c * alpha, c * alpha - c_old * s * next_beta
        r2 = s * alpha + c * c_old * next_beta
        r1 = c * alpha - s * c_old * next_beta
        size1 = np.hypot(r1, new_beta)
        c_old, c, s_old, s = c, r1 / size1, s, new_beta / size1
        d_old, d = d, (v - r3 * d_old - r2 * d) / size1
        x = x + c * eta * d
        eta, left, k = -s * eta, abs(s) * left, k + 1
        v_old, v, next_beta = v, w / new_beta if new_beta > 0 else w, new_beta
        if new_beta == 0:
            break
    error = float(np.linalg.norm(b - a(x))) / size
    return Solution(x, k, error, error * size <= 10 * goal)


def idrs(a: Apply, b: np.ndarray, s: int = 4, preconditioner: Apply = lambda r: r, guess=None, tolerance=None, max_iterations=None, seed: int = 0) -> Solution:
    """Induced dimension reduction: residuals in shrinking subspaces against s fixed vectors.

    After van Gijzen and Sonneveld, "Algorithm 913: an elegant IDR(s) variant that efficiently
    exploits biorthogonality properties" (2011).
    """
    x, size, goal, limit = _start(b, guess, tolerance, max_iterations, len(b))
    if size == 0:
        return Solution(np.zeros_like(x), 0, 0.0, True)
    n = len(b)
    s = min(s, n)
    p = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, s)))[0].T
    r = b - a(x) if guess is not None else b.astype(float).copy()
    g, u, m, omega, k = np.zeros((n, s)), np.zeros((n, s)), np.eye(s), 1.0, 0
    while np.linalg.norm(r) > goal and k < limit:
        f = p @ r
        for t in range(s):
            c = np.linalg.solve(m[t:, t:], f[t:])
            z = preconditioner(r - g[:, t:] @ c)
            ut = u[:, t:] @ c + omega * z
            gt = a(ut)
            for q in range(t):
                w = (p[q] @ gt) / m[q, q]
                gt, ut = gt - w * g[:, q], ut - w * u[:, q]
            g[:, t], u[:, t] = gt, ut
            m[t:, t] = p[t:] @ gt
            if m[t, t] == 0:
                break
            beta = f[t] / m[t, t]
            r, x, k = r - beta * gt, x + beta * ut, k + 1
            if np.linalg.norm(r) <= goal or k >= limit:
                break
            f[t + 1 :] -= beta * m[t + 1 :, t]
        else:
            z = preconditioner(r)
            w = a(z)
            omega = (w @ r) / (w @ w)
            rho = abs(w @ r) / (np.linalg.norm(w) * np.linalg.norm(r))
            omega = omega * 0.7 / rho if 0 < rho < 0.7 else omega
            r, x, k = r - omega * w, x + omega * z, k + 1
            continue
        break
    error = float(np.linalg.norm(b - a(x))) / size
    return Solution(x, k, error, error * size <= 10 * goal)


def idrstab(a: Apply, b: np.ndarray, s: int = 4, ell: int = 2, preconditioner: Apply = lambda r: r, guess=None, tolerance=None, max_iterations=None, seed: int = 0) -> Solution:
    """IDR(s)STAB(L): dimension reduction against s fixed vectors, L steps at a time, each cycle closed by a minimal-residual polynomial of degree L.

    After Sleijpen and van Gijzen, "Exploiting BiCGstab(l) strategies to induce dimension
    reduction" (2010). Preconditioned from the right; an iteration is a product with A.
    """
    y, size, goal, limit = _start(b, None, tolerance, max_iterations, len(b))
    if size == 0:
        return Solution(y, 0, 0.0, True)
    n = len(b)
    s = min(s, n)
    x0 = np.zeros(n) if guess is None else np.array(guess, float)
    op = lambda w: a(preconditioner(w))
    shadow = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, s)))[0]
    r = [b - a(x0) if guess is not None else b.astype(float).copy()]
    k = 0

    def finished() -> Solution:
        x = x0 + preconditioner(y)
        error = float(np.linalg.norm(b - a(x))) / size
        return Solution(x, k, error, error * size <= 10 * goal)

    def krylov() -> list[np.ndarray]:
        nonlocal k
        basis, images, w = [], [], r[0]
        for _ in range(s):
            for q in basis:
                w = w - (q @ w) * q
            length = np.linalg.norm(w)
            if length <= EPS * np.linalg.norm(r[0]):
                w = np.random.default_rng(seed + k).standard_normal(n)
                for q in basis:
                    w = w - (q @ w) * q
                length = np.linalg.norm(w)
            basis.append(w / length)
            images.append(op(basis[-1]))
            k += 1
            w = images[-1]
        return [np.array(basis).T, np.array(images).T]

    u = krylov()
    while np.linalg.norm(r[0]) > goal and k < limit:
        for j in range(1, ell + 1):
            sigma = shadow.T @ u[j]
            alpha = np.linalg.lstsq(sigma, shadow.T @ r[j - 1], rcond=None)[0]
            y = y + u[0] @ alpha
            for m in range(j):
                r[m] = r[m] - u[m + 1] @ alpha
            if np.linalg.norm(r[0]) <= goal:
                return finished()
            r.append(op(r[j - 1]))
            k += 1
            fresh: list[list[np.ndarray]] = [[] for _ in range(j + 2)]
            w = list(r)  # w[m] is A^m times the next direction
            for _ in range(s):
                beta = np.linalg.lstsq(sigma, shadow.T @ w[j], rcond=None)[0]
                w = [w[m] - u[m] @ beta for m in range(j + 1)]
                for p in range(len(fresh[0])):  # directions are kept orthonormal at their highest power
                    c = fresh[j][p] @ w[j]
                    w = [w[m] - c * fresh[m][p] for m in range(j + 1)]
                length = np.linalg.norm(w[j])
                if length == 0:
                    break
                w = [x / length for x in w]
                w.append(op(w[j]))
                k += 1
                for m in range(j + 2):
                    fresh[m].append(w[m])
                w = w[1:]
            if len(fresh[0]) < s:  # a breakdown: start again from the residual
                u = krylov()
                break
            u = [np.array(x).T for x in fresh]
        else:
            basis = np.array(r[1:]).T
            gamma = np.linalg.lstsq(basis, r[0], rcond=None)[0]
            y = y + np.array(r[:-1]).T @ gamma
            u0 = u[0] - sum(g * u[m + 1] for m, g in enumerate(gamma))
            u1 = u[1] - sum(g * u[m + 2] for m, g in enumerate(gamma))
            u = [u0, u1]
            r = [r[0] - basis @ gamma]
            continue
        r = [b - a(x0 + preconditioner(y))]
    return finished()


def lscg(op: Operator, b: np.ndarray, guess=None, tolerance=None, max_iterations=None, preconditioner: Apply = lambda r: r) -> Solution:
    """Least squares by conjugate gradients on the normal equations, A^T A never formed."""
    cols = op.m.cols if op.m is not None else len(op.transposed(b))
    x, _, _, limit = _start(b, guess, tolerance, max_iterations, cols)
    at_b = op.transposed(b)
    size = float(np.linalg.norm(at_b))
    if size == 0:
        return Solution(np.zeros(cols), 0, 0.0, True)
    goal = (EPS if tolerance is None else tolerance) * size
    r = b - op.apply(x) if guess is not None else b.astype(float).copy()
    s = op.transposed(r)
    z = preconditioner(s)
    p, sz, k = z.copy(), s @ z, 0
    while np.linalg.norm(s) > goal and k < limit:
        q = op.apply(p)
        step = sz / (q @ q)
        x, r = x + step * p, r - step * q
        s = op.transposed(r)
        z = preconditioner(s)
        sz, old = s @ z, sz
        p, k = z + sz / old * p, k + 1
    error = float(np.linalg.norm(s)) / size
    return Solution(x, k, error, error * size <= goal)


def lsmr(op: Operator, b: np.ndarray, tolerance=None, max_iterations=None) -> Solution:
    """Least squares by Golub-Kahan bidiagonalisation with two running rotations; |A^T r| falls monotonically."""
    cols = op.m.cols
    beta = float(np.linalg.norm(b))
    x = np.zeros(cols)
    if beta == 0:
        return Solution(x, 0, 0.0, True)
    u = b / beta
    v = op.transposed(u)
    alpha = float(np.linalg.norm(v))
    if alpha == 0:
        return Solution(x, 0, 0.0, True)
    v = v / alpha
    zeta_bar, alpha_bar, rho, rho_bar, c_bar, s_bar = alpha * beta, alpha, 1.0, 1.0, 1.0, 0.0
    h, h_bar = v.copy(), np.zeros(cols)
    first, k = abs(zeta_bar), 0
    limit = 2 * cols if max_iterations is None else max_iterations
    goal = (EPS if tolerance is None else tolerance) * first
    while abs(zeta_bar) > goal and k < limit:
        u = op.apply(v) - alpha * u
        beta = float(np.linalg.norm(u))
        u = u / beta if beta > 0 else u
        w = op.transposed(u) - beta * v
        alpha = float(np.linalg.norm(w))
        v = w / alpha if alpha > 0 else w
        rho_old, rho = rho, float(np.hypot(alpha_bar, beta))
        c, s = alpha_bar / rho, beta / rho
        theta, alpha_bar = s * alpha, c * alpha
        rho_bar_old, theta_bar = rho_bar, s_bar * rho
        rho_bar = float(np.hypot(c_bar * rho, theta))
        c_bar, s_bar = c_bar * rho / rho_bar, theta / rho_bar
        zeta, zeta_bar = c_bar * zeta_bar, -s_bar * zeta_bar
        h_bar = h - h_bar * (theta_bar * rho / (rho_old * rho_bar_old))
        x = x + zeta / (rho * rho_bar) * h_bar
        h = v - h * (theta / rho)
        k += 1
        if alpha == 0:
            break
    return Solution(x, k, abs(zeta_bar) / first, abs(zeta_bar) <= goal)


def lanczos(a: Apply, n: int, k: int, largest: bool = True, steps: int | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """k extreme eigenvalues (ascending) and vectors of a symmetric operator, with full reorthogonalisation."""
    m = min(n, steps or max(4 * k + 20, 40))
    q = np.zeros((n, m))
    w = np.random.default_rng(seed).standard_normal(n)
    alpha, beta = np.zeros(m), np.zeros(m)
    q[:, 0] = w / np.linalg.norm(w)
    used = m
    for t in range(m):
        w = a(q[:, t])
        alpha[t] = q[:, t] @ w
        for _ in range(2):
            w = w - q[:, : t + 1] @ (q[:, : t + 1].T @ w)
        beta[t] = np.linalg.norm(w)
        if t + 1 < m:
            if beta[t] < EPS * 10:
                used = t + 1
                break
            q[:, t + 1] = w / beta[t]
    tri = np.diag(alpha[:used]) + np.diag(beta[: used - 1], 1) + np.diag(beta[: used - 1], -1)
    values, vectors = np.linalg.eigh(tri)
    at = slice(used - k, used) if largest else slice(0, k)
    return values[at], q[:, :used] @ vectors[:, at]


def power_iteration(a: Apply, n: int, iterations: int = 100_000, tolerance: float = 1e-12, seed: int = 0) -> tuple[float, np.ndarray]:
    """The eigenvalue of largest magnitude and its vector.

    Converged when the value changes by tolerance at most and the residual |A x - value x|, of
    which a symmetric operator's value has the square as its error, is within its root (both
    relative to the value). An ArithmeticError if iterations are used up before that.
    """
    x = np.random.default_rng(seed).standard_normal(n)
    x /= np.linalg.norm(x)
    value = 0.0
    for _ in range(iterations):
        y = a(x)
        fresh = float(x @ y)
        if abs(fresh - value) <= tolerance * abs(fresh) and np.linalg.norm(y - fresh * x) <= tolerance**0.5 * abs(fresh):
            return fresh, x
        x = y / np.linalg.norm(y)
        value = fresh
    raise ArithmeticError(f"power iteration has not converged after {iterations} iterations")


def conjugate_gradient_distributed(m: Matrix, b: Matrix, tolerance: float = 1e-8, max_iterations: int = 100, every: int = 1) -> tuple[Matrix, int, float]:
    """CG with Jacobi preconditioning whose vectors are DataFrames (i, x, r, p): for systems larger than the driver.

    Each iteration is one product and two scalar aggregates; every so many iterations the
    state is checkpointed (reliable, in the cluster's folder), which keeps the plan small.
    """
    diagonal = m.df.where("i = j").select("i", F.col("v").alias("d"))
    state = m.df.sparkSession.range(m.rows).select(F.col("id").alias("i")).join(b.df.select("i", F.col("v").alias("r")), "i", "left").join(diagonal, "i", "left")
    d = F.when(F.coalesce("d", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("d"))
    state = state.select("i", F.lit(0.0).alias("x"), F.coalesce("r", F.lit(0.0)).alias("r"), d.alias("d")).withColumn("p", F.col("r") / F.col("d"))
    state = cut(state)
    rz, rr = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d")), F.sum(F.col("r") * F.col("r"))).first()
    goal, k = tolerance * tolerance * rr, 0
    held: list[DataFrame] = []  # cached since the last checkpoint
    while rr > goal and k < max_iterations:
        q = m.df.join(state.select(F.col("i").alias("j"), "p"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("p")).alias("q"))
        product = state.join(q, "i", "left").withColumn("q", F.coalesce("q", F.lit(0.0))).persist()
        held.append(product)
        step = rz / product.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        fresh = product.select("i", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("q")).alias("r"), "d", "p")
        old, (rz, rr) = rz, fresh.agg(F.sum(F.col("r") * F.col("r") / F.col("d")), F.sum(F.col("r") * F.col("r"))).first()
        state = fresh.withColumn("p", F.col("r") / F.col("d") + rz / old * F.col("p"))
        k += 1
        if k % every == 0:
            state = cut(state)
            for df in held:
                df.unpersist()
            held = []
    state = cut(state) if held else state
    for df in held:
        df.unpersist()
    return Matrix(state.select("i", F.lit(0).cast("long").alias("j"), F.col("x").alias("v")), m.cols, 1), k, float(np.sqrt(rr))
