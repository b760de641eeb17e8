"""The basic linear algebra subprograms' operations on matrices as relations: vectors are single-column matrices.

Each returns a new matrix (or a one-row DataFrame for a scalar); nothing is written in place.
uplo is "lower" or "upper", trans whether the matrix is taken transposed, unit whether a
triangle's diagonal counts as ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.operators import sparse_direct
from veldt.operators.matrix import Matrix


def _op(a: Matrix, trans: bool) -> Matrix:
    return a.transpose() if trans else a


def _triangle(a: Matrix, uplo: str, unit: bool) -> Matrix:
    return a.triangular(f"unit_{uplo}" if unit else uplo)


# ---- vectors


def scal(alpha: float, x: Matrix) -> Matrix:
    return x.scale(alpha)


def axpy(alpha: float, x: Matrix, y: Matrix) -> Matrix:
    """alpha x + y."""
    return x.scale(alpha) + y


def dot(x: Matrix, y: Matrix) -> DataFrame:
    return x.dot(y)


def nrm2(x: Matrix) -> DataFrame:
    """The 2-norm, without overflow."""
    return x.stable_norm()


def asum(x: Matrix) -> DataFrame:
    return x.reduce(x.aggregate("l1").alias("asum"))


def iamax(x: Matrix) -> DataFrame:
    """The first place of the largest magnitude."""
    return x.map(F.abs).arg_extreme(True).select("i")


def rot(x: Matrix, y: Matrix, c: float, s: float) -> tuple[Matrix, Matrix]:
    """(c x + s y, c y - s x)."""
    return x.scale(c) + y.scale(s), y.scale(c) + x.scale(-s)


# ---- matrix and vector


def gemv(alpha: float, a: Matrix, x: Matrix, beta: float = 0.0, y: Matrix | None = None, trans: bool = False) -> Matrix:
    """alpha op(A) x + beta y."""
    out = (_op(a, trans) @ x).scale(alpha)
    return out if y is None or beta == 0 else out + y.scale(beta)


def ger(alpha: float, x: Matrix, y: Matrix, a: Matrix) -> Matrix:
    """A + alpha x y^T."""
    return a + x.outer(y).scale(alpha)


def symv(alpha: float, a: Matrix, x: Matrix, beta: float = 0.0, y: Matrix | None = None, uplo: str = "lower") -> Matrix:
    return gemv(alpha, a.selfadjoint(uplo), x, beta, y)


def trmv(a: Matrix, x: Matrix, uplo: str = "lower", trans: bool = False, unit: bool = False) -> Matrix:
    return _op(_triangle(a, uplo, unit), trans) @ x


def trsv(a: Matrix, b: Matrix, uplo: str = "lower", trans: bool = False, unit: bool = False) -> Matrix:
    """op(A) x = b in one bounded task (sparse_direct.level_solve has no bound)."""
    other = {"lower": "upper", "upper": "lower"}[uplo] if trans else uplo
    return sparse_direct.solve(_op(a, trans), b, f"unit_{other}" if unit else other)


def gbmv(alpha: float, a: Matrix, x: Matrix, below: int, above: int) -> Matrix:
    """The product with A's band."""
    return (a.banded(below, above) @ x).scale(alpha)


def syr(alpha: float, x: Matrix, a: Matrix) -> Matrix:
    return a.rank_update(x, alpha)


def syr2(alpha: float, x: Matrix, y: Matrix, a: Matrix) -> Matrix:
    return a.rank_update(x, alpha, y)


# ---- matrices


def gemm(alpha: float, a: Matrix, b: Matrix, beta: float = 0.0, c: Matrix | None = None, trans_a: bool = False, trans_b: bool = False) -> Matrix:
    """alpha op(A) op(B) + beta C."""
    out = (_op(a, trans_a) @ _op(b, trans_b)).scale(alpha)
    return out if c is None or beta == 0 else out + c.scale(beta)


def symm(alpha: float, a: Matrix, b: Matrix, beta: float = 0.0, c: Matrix | None = None, uplo: str = "lower", right: bool = False) -> Matrix:
    full = a.selfadjoint(uplo)
    return gemm(alpha, b, full, beta, c) if right else gemm(alpha, full, b, beta, c)


def syrk(alpha: float, a: Matrix, beta: float = 0.0, c: Matrix | None = None, trans: bool = False) -> Matrix:
    """alpha A A^T + beta C (with trans, A^T A)."""
    return gemm(alpha, a, a, beta, c, trans, not trans)


def syr2k(alpha: float, a: Matrix, b: Matrix, beta: float = 0.0, c: Matrix | None = None) -> Matrix:
    """alpha (A B^T + B A^T) + beta C."""
    return gemm(alpha, a, b, 1.0, gemm(alpha, b, a, beta, c, False, True), False, True)


def trmm(alpha: float, a: Matrix, b: Matrix, uplo: str = "lower", trans: bool = False, unit: bool = False, right: bool = False) -> Matrix:
    t = _op(_triangle(a, uplo, unit), trans)
    return (b @ t if right else t @ b).scale(alpha)


def trsm(alpha: float, a: Matrix, b: Matrix, uplo: str = "lower", trans: bool = False, unit: bool = False, right: bool = False) -> Matrix:
    """op(A) X = alpha B, or with right X op(A) = alpha B."""
    if right:
        return trsv(a, b.transpose().scale(alpha), uplo, not trans, unit).transpose()
    return trsv(a, b.scale(alpha), uplo, trans, unit)
