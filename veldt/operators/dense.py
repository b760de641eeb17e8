"""Dense decompositions: bounded blocks in Arrow groups, and tall matrices by distributed reductions.

A block is a whole matrix (or one per key) of at most MAX_BLOCK cells, gathered in one
group and handed to a NumPy kernel. Tall matrices are reduced first: R of a QR by a tree
of local ones, normal equations by one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.operators import factorizations as X
from veldt.operators import kernels as K
from veldt.operators.matrix import Matrix

MAX_BLOCK = 4096 * 4096


def guard(rows: int, cols: int) -> None:
    if rows * cols > MAX_BLOCK:
        raise ValueError(f"{rows} x {cols} is too large for one block; use an iterative solver or tsqr")


def array_of(pdf: pd.DataFrame, rows: int, cols: int) -> np.ndarray:
    a = np.zeros((rows, cols))
    a[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["v"].to_numpy()
    return a


def on_block(m: Matrix, f: Callable[[np.ndarray], pd.DataFrame], schema: str, key: str | None = None, extra: DataFrame | None = None) -> DataFrame:
    """f on the dense matrix (one per value of `key`, a long column of m.df); its frame has the schema's columns."""
    guard(m.rows, m.cols)
    rows, cols = m.rows, m.cols
    if key is None:

        def whole(frames):
            held = list(frames)
            yield f(array_of(pd.concat(held), rows, cols) if held else np.zeros((rows, cols)))

        return m.df.select("i", "j", F.col("v").cast("double").alias("v")).repartition(1).mapInPandas(whole, schema)
    return m.df.groupBy(key).applyInPandas(lambda pdf: f(array_of(pdf, rows, cols)).assign(**{key: pdf[key].iloc[0]}), f"{schema}, {key} long")


def _coo(a: np.ndarray, name: str | None = None) -> pd.DataFrame:
    i, j = np.indices(a.shape)
    out = pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": np.asarray(a, float).ravel()})
    return out if name is None else out.assign(part=name)


def factor(m: Matrix, kind: str, key: str | None = None) -> DataFrame:
    """Factors as (part, i, j, v). Kinds and parts:

    llt: L (no rows where the matrix isn't positive definite); ldlt: P, L, D; bunch_kaufman:
    P, L, D (2 x 2 pivots off its diagonal); inertia: S. lu: P, L, U; full_lu: P, Q, U, rank.
    qr: Q, R; colpiv_qr and randomized_qr: Q, R, P, rank; fullpiv_qr: also rows; cod: Q, T, Z, P, rank;
    bidiagonal: U, B, V; svd: U, S, V. eigh: S, V; eig: re, im, V_re, V_im; schur: T, U (real,
    2 x 2 blocks for complex pairs); complex_schur: T_re, T_im, U_re, U_im; hessenberg: Q, H.
    """

    def run(a: np.ndarray) -> pd.DataFrame:
        col = lambda x: np.asarray(x, float).reshape(-1, 1)
        if kind == "llt":
            low = K.llt(a)
            parts = {} if low is None else {"L": low}
        elif kind == "ldlt":
            p, low, d = K.ldlt(a)
            parts = {"P": col(p), "L": low, "D": col(d)}
        elif kind == "lu":
            p, low, u, _ = K.lu_partial(a)
            parts = {"P": col(p), "L": low, "U": u}
        elif kind == "full_lu":
            p, q, u, rank = K.lu_full(a)
            parts = {"P": col(p), "Q": col(q), "U": u, "rank": col([rank])}
        elif kind == "qr":
            q, r = np.linalg.qr(a)
            sign = np.where(np.diag(r) < 0, -1.0, 1.0)
            parts = {"Q": q * sign, "R": r * sign[:, None]}
        elif kind == "colpiv_qr":
            q, r, p, rank = K.qr_colpiv(a)
            parts = {"Q": q, "R": r, "P": col(p), "rank": col([rank])}
        elif kind == "svd":
            u, s, vt = np.linalg.svd(a, full_matrices=False)
            parts = {"U": u, "S": col(s), "V": vt.T}
        elif kind == "eigh":
            w, z = np.linalg.eigh((a + a.T) / 2)
            parts = {"S": col(w), "V": z}
        elif kind == "eig":
            w, z = X.eigenvectors(a)
            parts = {"re": col(w.real), "im": col(w.imag), "V_re": z.real, "V_im": z.imag}
        elif kind == "schur":
            u, t = X.real_schur(a)
            parts = {"T": t, "U": u}
        elif kind == "complex_schur":
            u, t = K.schur(a)
            parts = {"T_re": t.real, "T_im": t.imag, "U_re": u.real, "U_im": u.imag}
        elif kind == "bunch_kaufman":
            p, low, d, e = X.bunch_kaufman(a)
            parts = {"P": col(p), "L": low, "D": np.diag(d) + (np.diag(e, 1) + np.diag(e, -1) if len(e) else 0)}
        elif kind == "randomized_qr":
            q, r, p, rank = X.qr_randomized(a)
            parts = {"Q": q, "R": r, "P": col(p), "rank": col([rank])}
        elif kind == "fullpiv_qr":
            q, r, rows, p, rank = X.qr_fullpiv(a)
            parts = {"Q": q, "R": r, "P": col(p), "rows": col(rows), "rank": col([rank])}
        elif kind == "cod":
            q, t, z, p, rank = X.complete_orthogonal(a)
            parts = {"Q": q, "T": t, "Z": z, "P": col(p), "rank": col([rank])}
        elif kind == "bidiagonal":
            u, b, z = X.bidiagonal(a)
            parts = {"U": u, "B": b, "V": z}
        elif kind == "hessenberg":
            q, h = K.hessenberg(a)
            parts = {"Q": q, "H": h}
        elif kind == "inertia":
            parts = {"S": col(X.inertia(a))}
        else:
            raise ValueError(kind)
        frames = [_coo(x, n) for n, x in parts.items()]
        return pd.concat(frames)[["part", "i", "j", "v"]] if frames else pd.DataFrame({"part": pd.Series(dtype=str), "i": pd.Series(dtype=np.int64), "j": pd.Series(dtype=np.int64), "v": pd.Series(dtype=float)})

    return on_block(m, run, "part string, i long, j long, v double", key)


SCALARS: dict[str, Callable[[np.ndarray], float]] = {
    "determinant": np.linalg.det, "log_abs_determinant": lambda a: np.linalg.slogdet(a)[1], "sign_determinant": lambda a: np.linalg.slogdet(a)[0],
    "rcond": K.rcond1, "rank": lambda a: float(K.lu_full(a)[3]), "operator_norm": lambda a: float(np.linalg.norm(a, 2)), "trace": np.trace,
}


def scalar(m: Matrix, name: str, key: str | None = None) -> DataFrame:
    f = SCALARS[name]
    return on_block(m, lambda a: pd.DataFrame({name: [float(f(a))]}), f"{name} double", key)


MATRICES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "inverse": np.linalg.inv, "pinv": np.linalg.pinv, "kernel": K.kernel, "image": K.image, "exp": K.expm, "log": K.logm, "sqrt": K.sqrtm,
    "cos": K.cosm, "sin": K.sinm, "cosh": lambda a: (K.expm(a) + K.expm(-a)) / 2, "sinh": lambda a: (K.expm(a) - K.expm(-a)) / 2,
    "operator_sqrt": lambda a: (lambda w, z: z * np.sqrt(w) @ z.T)(*np.linalg.eigh(a)), "operator_inverse_sqrt": lambda a: (lambda w, z: z / np.sqrt(w) @ z.T)(*np.linalg.eigh(a)),
}


def matrix_function(m: Matrix, name: str, power: float | None = None) -> Matrix:
    """inverse, pinv, kernel, image, or a matrix function (name="pow" with a real power)."""
    f = (lambda a: K.powm(a, power)) if name == "pow" else MATRICES[name]
    return Matrix(on_block(m, lambda a: _coo(np.real(f(a))), "i long, j long, v double"), m.rows, m.cols)


def solve(a: Matrix, b: Matrix, kind: str = "lu") -> Matrix:
    """A X = B in one block: lu, llt (no rows where it fails), ldlt, bunch_kaufman, qr, min_norm or cod (least squares), and by substitution lower, upper, unit_lower, unit_upper."""
    guard(a.rows, a.cols + b.cols)
    cols, both = a.cols, a.hcat(b)

    def run(x: np.ndarray) -> pd.DataFrame:
        m, r = x[:, :cols], x[:, cols:]
        if kind == "llt":
            low = K.llt(m)
            out = np.zeros((0, 0)) if low is None else X.back_substitute(low.T, X.forward_substitute(low, r))
        elif kind == "ldlt":
            p, low, d = K.ldlt(m)
            out = np.zeros_like(r)
            out[p] = X.back_substitute(low.T, X.forward_substitute(low, r[p], True) / np.where(d == 0, np.inf, d)[:, None], True)
        elif kind == "bunch_kaufman":
            out = X.bunch_kaufman_solve(m, r)
        elif kind == "cod":
            out = X.min_norm(m, r)
        elif kind in ("qr", "min_norm"):
            out = K.min_norm_solve(m, r)
        elif kind.endswith("lower"):
            out = X.forward_substitute(np.tril(m), r, kind.startswith("unit"))
        elif kind.endswith("upper"):
            out = X.back_substitute(np.triu(m), r, kind.startswith("unit"))
        else:
            out = np.linalg.solve(m, r)
        return _coo(out)

    return Matrix(on_block(both, run, "i long, j long, v double"), cols, b.cols)


def generalized_eigenvalues(a: Matrix, b: Matrix, selfadjoint: bool = True) -> DataFrame:
    """(k, re, im) sorted; infinite ones (of a singular B) have re = inf and come last, undetermined ones are NaN."""
    cols = a.cols

    def run(x: np.ndarray) -> pd.DataFrame:
        if selfadjoint:
            w = K.generalized_selfadjoint(x[:, :cols], x[:, cols:])[0].astype(complex)
        else:
            alpha, beta = X.generalized_eigenvalues(x[:, :cols], x[:, cols:])
            w = np.array([p / q if q != 0 else complex(np.inf if p != 0 else np.nan, 0) for p, q in zip(alpha, beta)], complex)
            w = w[np.lexsort((w.imag, w.real))]
        return pd.DataFrame({"k": np.arange(len(w)), "re": w.real, "im": w.imag})

    return on_block(a.hcat(b), run, "k long, re double, im double")


def generalized_schur(a: Matrix, b: Matrix) -> DataFrame:
    """(part, i, j, v) of the QZ form A = Q S Z^H, B = Q T Z^H: parts Q, S, T, Z, each _re and _im."""
    cols = a.cols

    def run(x: np.ndarray) -> pd.DataFrame:
        named = zip("QSTZ", X.qz(x[:, :cols], x[:, cols:]))
        return pd.concat([_coo(f(m), n + tail) for n, m in named for f, tail in ((np.real, "_re"), (np.imag, "_im"))])[["part", "i", "j", "v"]]

    return on_block(a.hcat(b), run, "part string, i long, j long, v double")


def tridiagonal_spectrum(diagonal: Matrix, off: Matrix, vectors: bool = True) -> DataFrame:
    """(part, i, j, v) of a symmetric tridiagonal matrix: S by bisection, V by inverse iteration."""
    n = diagonal.rows

    def run(x: np.ndarray) -> pd.DataFrame:
        w = K.tridiagonal_eigenvalues(x[:, 0], x[: n - 1, 1])
        parts = [_coo(w.reshape(-1, 1), "S")] + ([_coo(X.tridiagonal_vectors(x[:, 0], x[: n - 1, 1], w), "V")] if vectors else [])
        return pd.concat(parts)[["part", "i", "j", "v"]]

    return on_block(diagonal.hcat(Matrix(off.df, n, 1)), run, "part string, i long, j long, v double")


# ---- tall matrices


def tsqr_r(rows: DataFrame, array_column: str, cols: int) -> DataFrame:
    """R (positive diagonal) of a tall matrix with a row per array cell, as (i, j, v).

    Each partition reduces its rows to a cols x cols triangle; triangles meet eight at a time.
    """

    def local(frames):
        held = None
        for pdf in frames:
            part = np.vstack(pdf["row"].to_numpy()) if len(pdf) else np.zeros((0, cols))
            held = part if held is None else np.vstack([held, part])
            held = np.linalg.qr(held, mode="r")
        if held is not None and len(held):
            yield pd.DataFrame({"row": [list(map(float, r)) for r in held]})

    df = rows.select(F.col(array_column).cast("array<double>").alias("row")).mapInPandas(local, "row array<double>")
    n = 64
    while n >= 1:
        df = df.repartition(n, F.spark_partition_id() % n).mapInPandas(local, "row array<double>")
        n //= 8
    def last(frames):
        for pdf in frames:
            r = np.linalg.qr(np.vstack(pdf["row"].to_numpy()), mode="r")
            r = r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]
            yield _coo(r)

    return df.mapInPandas(last, "i long, j long, v double")


def gram_frame(rows: DataFrame, array_column: str, cols: int) -> DataFrame:
    """A^T A of row arrays as (i, j, v): one cols x cols product per partition, then one small aggregate."""
    guard(cols, cols)

    def local(frames):
        total = np.zeros((cols, cols))
        for pdf in frames:
            if len(pdf):
                a = np.vstack(pdf["row"].to_numpy()).astype(float)
                total += a.T @ a
        yield pd.DataFrame({"g": [total.ravel().tolist()]})

    parts = rows.select(F.col(array_column).alias("row")).mapInPandas(local, "g array<double>")
    sums = parts.select(F.posexplode("g").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    return sums.select(F.floor(F.col("k") / cols).cast("long").alias("i"), (F.col("k") % cols).cast("long").alias("j"), "v")


def gram_arrays(rows: DataFrame, array_column: str, cols: int) -> np.ndarray:
    """The same on the driver: cols**2 numbers."""
    out = np.zeros((cols, cols))
    for r in gram_frame(rows, array_column, cols).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def least_squares(rows: DataFrame, array_column: str, target: str, cols: int) -> np.ndarray:
    """min |A x - b| for a tall matrix by its normal equations (one aggregate)."""
    both = rows.select(F.concat(F.col(array_column).cast("array<double>"), F.array(F.col(target).cast("double"))).alias("row"))
    g = gram_arrays(both, "row", cols + 1)
    return K.min_norm_solve(g[:cols, :cols], g[:cols, cols])


def nnls(rows: DataFrame, array_column: str, target: str, cols: int) -> np.ndarray:
    both = rows.select(F.concat(F.col(array_column).cast("array<double>"), F.array(F.col(target).cast("double"))).alias("row"))
    g = gram_arrays(both, "row", cols + 1)
    return K.nnls(g[:cols, :cols], g[:cols, cols])


def randomized_range(m: Matrix, k: int, seed: int = 0) -> Matrix:
    """A sketch A * Omega whose columns span most of the range (for randomised pivoting and SVD)."""
    return m @ Matrix.random(m.df.sparkSession, m.cols, k, seed, normal=True)
