"""Queries of decompositions, matrix functions, fits and solvers: each gives back the matrix, or the solution, that SQL states."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from veldt.operators import dense, fit, kernels, solvers, sparse_direct
from veldt.operators.matrix import Matrix
from veldt.plans._register import E_SQL, query, r6, table

N = 64
G_SQL = f"{E_SQL}, g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM e a JOIN e b USING (i) GROUP BY a.j, b.j)"
A_SQL = f"WITH {G_SQL} SELECT i, j, round(v + CASE WHEN i = j THEN 1 ELSE 0 END, 5) + 0.0 AS v FROM g"
#: Not symmetric, with complex eigenvalues.
N_SQL = f"WITH {G_SQL} SELECT i, j, round(v + (j - i) / 8.0, 5) + 0.0 AS v FROM g"
#: Indefinite.
H_SQL = f"WITH {G_SQL}, t AS (SELECT sum(v) / 64 AS t FROM g WHERE i = j) SELECT i, j, round(v - CASE WHEN i = j THEN t ELSE 0 END, 5) + 0.0 AS v FROM g, t"
I_SQL = "SELECT a.range AS i, b.range AS j, CASE WHEN a.range = b.range THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(64) a, range(64) b"


def _gram(s, d):
    return Matrix(dense.gram_frame(table(s, d, "embeddings"), "embedding", N), N, N)


def _spd(s, d):
    return _gram(s, d) + Matrix.identity(s, N)


def _skewed(s, d):
    return _gram(s, d).map_indexed(lambda i, j, v: v + (j - i) / 8.0)


def _indefinite(s, d):
    g = _gram(s, d)
    t = g.df.agg(g.aggregate("trace")).first()[0] / N
    return g + Matrix.identity(s, N).scale(-t)


def _parts(factors, *names):
    """Parts as matrices; a diagonal is a column."""
    return [Matrix(factors.where(F.col("part") == n).select("i", "j", "v"), N, N) for n in names]


def _permutation(factors, name="P"):
    return factors.where(F.col("part") == name).select("i", F.col("v").cast("long").alias("p"))


def _r5(m: Matrix):
    return m.df.select("i", "j", (F.round("v", 5) + F.lit(0.0)).alias("v"))


def _column(m: Matrix) -> Matrix:
    return Matrix(m.df.where("j = 0"), N, 1)


@query("ldlt_reconstructed", A_SQL)
def ldlt_reconstructed(s, d):
    f = dense.factor(_spd(s, d), "ldlt")
    low, pivots = _parts(f, "L", "D")
    return _r5((low.scale_cols(_column(pivots)) @ low.transpose()).twisted_by(_permutation(f)))


@query("bunch_kaufman_reconstructed", H_SQL)
def bunch_kaufman_reconstructed(s, d):
    f = dense.factor(_indefinite(s, d), "bunch_kaufman")
    low, pivots = _parts(f, "L", "D")
    return _r5((low @ pivots @ low.transpose()).twisted_by(_permutation(f)))


@query("lu_reconstructed", N_SQL)
def lu_reconstructed(s, d):
    f = dense.factor(_skewed(s, d), "lu")
    low, up = _parts(f, "L", "U")
    return _r5((low @ up).permuted(left=_permutation(f)))


@query("qr_r_squared", f"WITH {G_SQL} SELECT i, j, round(v, 5) + 0.0 AS v FROM g")
def qr_r_squared(s, d):
    """R^T R of the tall matrix's tree QR."""
    r = Matrix(dense.tsqr_r(table(s, d, "embeddings"), "embedding", N), N, N)
    return _r5(r.transpose() @ r)


def _register_qr(kind):
    @query(f"{kind}_reconstructed", N_SQL)
    def run(s, d):
        f = dense.factor(_skewed(s, d), kind)
        q, r = _parts(f, "Q", "R")
        return _r5((q @ r).permuted(right=_permutation(f)) if kind != "qr" else q @ r)


for _kind in ("qr", "colpiv_qr", "fullpiv_qr", "randomized_qr"):
    _register_qr(_kind)


@query("complete_orthogonal_reconstructed", N_SQL)
def complete_orthogonal_reconstructed(s, d):
    f = dense.factor(_skewed(s, d), "cod")
    q, t, z = _parts(f, "Q", "T", "Z")
    return _r5((q @ t @ z).permuted(right=_permutation(f)))


@query("bidiagonal_reconstructed", N_SQL)
def bidiagonal_reconstructed(s, d):
    u, b, z = _parts(dense.factor(_skewed(s, d), "bidiagonal"), "U", "B", "V")
    return _r5(u @ b.banded(0, 1) @ z.transpose())


@query("svd_reconstructed", N_SQL)
def svd_reconstructed(s, d):
    u, w, z = _parts(dense.factor(_skewed(s, d), "svd"), "U", "S", "V")
    return _r5(u.scale_cols(_column(w)) @ z.transpose())


@query("svd_moments", f"WITH {G_SQL} SELECT (SELECT round(sum(v), 3) FROM g WHERE i = j) AS second, round(sum(v * v), 2) AS fourth, CAST(64 AS BIGINT) AS n, true AS sorted FROM g")
def svd_moments(s, d):
    """Sums of the second and fourth powers of the tall matrix's singular values, which are the trace of A^T A and its squared norm."""
    r = Matrix(dense.tsqr_r(table(s, d, "embeddings"), "embedding", N), N, N)
    w = dense.factor(r, "svd").where("part = 'S'")
    order = F.sort_array(F.collect_list(F.struct("i", "v")))
    values = F.transform(order, lambda x: x["v"])
    return w.agg(F.round(F.sum(F.col("v") ** 2), 3).alias("second"), F.round(F.sum(F.col("v") ** 4), 2).alias("fourth"), F.count("*").alias("n"), (values == F.reverse(F.array_sort(values))).alias("sorted"))


@query("eigh_reconstructed", A_SQL)
def eigh_reconstructed(s, d):
    w, z = _parts(dense.factor(_spd(s, d), "eigh"), "S", "V")
    return _r5(z.scale_cols(_column(w)) @ z.transpose())


@query("spectrum_trace", f"WITH {E_SQL} SELECT round(sum(v * v) + 64, 4) AS total FROM e")
def spectrum_trace(s, d):
    return dense.factor(_spd(s, d), "eigh").where("part = 'S'").agg(F.round(F.sum("v"), 4).alias("total"))


@query("eigenvector_residual", "SELECT 0.0::DOUBLE AS residual, true AS has_pairs")
def eigenvector_residual(s, d):
    """max |A V - V W| of complex eigenvalues and vectors."""
    a = _skewed(s, d)
    f = dense.factor(a, "eig")
    re, im, vr, vi = _parts(f, "re", "im", "V_re", "V_im")
    left = a @ vr, a @ vi
    right = vr.scale_cols(_column(re)) - vi.scale_cols(_column(im)), vr.scale_cols(_column(im)) + vi.scale_cols(_column(re))
    worst = (left[0] - right[0]).df.unionByName((left[1] - right[1]).df).agg(F.round(F.max(F.abs("v")), 6).alias("residual"))
    return worst.crossJoin(F.broadcast(f.where("part = 'im'").agg((F.max("v") > 0.001).alias("has_pairs"))))


@query("real_schur_reconstructed", N_SQL)
def real_schur_reconstructed(s, d):
    t, u = _parts(dense.factor(_skewed(s, d), "schur"), "T", "U")
    return _r5(u @ t.banded(1, N) @ u.transpose())


def _times(a, b):
    """The product of complex matrices (re, im)."""
    return a[0] @ b[0] - a[1] @ b[1], a[0] @ b[1] + a[1] @ b[0]


def _adjoint(a):
    return a[0].transpose(), a[1].transpose().scale(-1.0)


@query("complex_schur_reconstructed", N_SQL)
def complex_schur_reconstructed(s, d):
    tr, ti, ur, ui = _parts(dense.factor(_skewed(s, d), "complex_schur"), "T_re", "T_im", "U_re", "U_im")
    u = (ur, ui)
    return _r5(_times(_times(u, (tr.triangular("upper"), ti.triangular("upper"))), _adjoint(u))[0])


@query("hessenberg_reconstructed", N_SQL)
def hessenberg_reconstructed(s, d):
    q, h = _parts(dense.factor(_skewed(s, d), "hessenberg"), "Q", "H")
    return _r5(q @ h.banded(1, N) @ q.transpose())


@query("qz_reconstructed", N_SQL)
def qz_reconstructed(s, d):
    """Q S Z^H of the generalised Schur form with a singular second matrix."""
    f = dense.generalized_schur(_skewed(s, d), _spd(s, d).prune(lambda i, j, v: i >= 3))
    q, m, z = (tuple(_parts(f, f"{n}_re", f"{n}_im")) for n in "QSZ")
    return _r5(_times(_times(q, m), _adjoint(z))[0])


@query("generalized_eigenvalues", "SELECT range AS k, 0.5::DOUBLE AS re, 0.0::DOUBLE AS im FROM range(64)")
def generalized_eigenvalues(s, d):
    a = _spd(s, d)
    return dense.generalized_eigenvalues(a, a.scale(2.0)).select("k", r6("re").alias("re"), r6("im").alias("im"))


@query("generalized_eigenvalues_singular", "SELECT CAST(3 AS BIGINT) AS infinite, CAST(61 AS BIGINT) AS finite")
def generalized_eigenvalues_singular(s, d):
    """Infinite and finite eigenvalues where three rows of the second matrix are zero."""
    w = dense.generalized_eigenvalues(_spd(s, d), Matrix.identity(s, N).prune(lambda i, j, v: i >= 3), selfadjoint=False)
    return w.agg(F.count_if(F.col("re") == F.lit(float("inf"))).alias("infinite"), F.count_if(F.abs("re") < F.lit(float("inf"))).alias("finite"))


@query("log_determinant", f"WITH {G_SQL} SELECT round(sum(ln(v + 1)), 5) AS log, 1.0::DOUBLE AS sign FROM g WHERE i = j")
def log_determinant(s, d):
    """Of a triangular matrix: the product of its diagonal."""
    t = _spd(s, d).triangular("lower")
    return dense.scalar(t, "log_abs_determinant").select(F.round("log_abs_determinant", 5).alias("log")).crossJoin(F.broadcast(dense.scalar(t, "sign_determinant").select(F.col("sign_determinant").alias("sign"))))


@query("diagonal_scalars", f"WITH {G_SQL}, x AS (SELECT v FROM g WHERE i = j) SELECT round(max(v), 5) AS operator_norm, round(min(v) / max(v), 8) AS rcond, 64.0::DOUBLE AS rank, round(sum(v), 4) AS trace FROM x")
def diagonal_scalars(s, d):
    """Norm, condition, rank and trace of a diagonal matrix."""
    m = _gram(s, d).diagonal().as_diagonal()
    m = Matrix(m.df, N, N)
    out = None
    for name, places in (("operator_norm", 5), ("rcond", 8), ("rank", 0), ("trace", 4)):
        one = dense.scalar(m, name).select(F.round(name, places).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


@query("rank_and_kernel", "SELECT 32.0::DOUBLE AS rank, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS inner_inverse")
def rank_and_kernel(s, d):
    """A matrix whose columns come twice: its rank, A times its null space, and A pinv(A) A - A."""
    half = list(range(32))
    a = _gram(s, d).indexed(None, half + half)
    rank = dense.scalar(a, "rank").select(F.col("rank"))
    null = a @ Matrix(dense.matrix_function(a, "kernel").df, N, N)
    worst = null.df.agg(F.round(F.max(F.abs("v")), 6).alias("residual"))
    inner = (a @ dense.matrix_function(a, "pinv") @ a - a).df.agg(F.round(F.max(F.abs("v")), 6).alias("inner_inverse"))
    return rank.crossJoin(F.broadcast(worst)).crossJoin(F.broadcast(inner))


@query("exponential_inverse", I_SQL)
def exponential_inverse(s, d):
    """exp(A) exp(-A), A the Gram matrix scaled to a trace of 8."""
    a = _scaled(s, d)
    return _r5(dense.matrix_function(a, "exp") @ dense.matrix_function(a.scale(-1.0), "exp"))


def _scaled(s, d):
    g = _gram(s, d)
    return g.scale(8 / g.df.agg(g.aggregate("trace")).first()[0])


B_SQL = f"WITH {G_SQL}, t AS (SELECT sum(v) AS t FROM g WHERE i = j) SELECT i, j, round(8 * v / t + CASE WHEN i = j THEN 1 ELSE 0 END, 5) + 0.0 AS v FROM g, t"


@query("exponential_of_logarithm", B_SQL)
def exponential_of_logarithm(s, d):
    a = _scaled(s, d) + Matrix.identity(s, N)
    return _r5(dense.matrix_function(dense.matrix_function(a, "log"), "exp"))


@query("power_of_a_half_squared", B_SQL)
def power_of_a_half_squared(s, d):
    root = dense.matrix_function(_scaled(s, d) + Matrix.identity(s, N), "pow", 0.5)
    return _r5(root @ root)


@query("sine_and_cosine", I_SQL)
def sine_and_cosine(s, d):
    """sin(A)^2 + cos(A)^2."""
    a = _scaled(s, d)
    sine, cosine = dense.matrix_function(a, "sin"), dense.matrix_function(a, "cos")
    return _r5(sine @ sine + cosine @ cosine)


@query("hyperbolic_sine_and_cosine", I_SQL)
def hyperbolic_sine_and_cosine(s, d):
    """cosh(A)^2 - sinh(A)^2."""
    a = _scaled(s, d)
    sine, cosine = dense.matrix_function(a, "sinh"), dense.matrix_function(a, "cosh")
    return _r5(cosine @ cosine - sine @ sine)


@query("operator_inverse_sqrt", I_SQL)
def operator_inverse_sqrt(s, d):
    """A^(-1/2) A A^(-1/2)."""
    a = _spd(s, d)
    root = dense.matrix_function(a, "operator_inverse_sqrt")
    return _r5(root @ a @ root)


# ---- fits


@query("least_squares_residual", "SELECT range AS j, 0.0::DOUBLE AS v FROM range(64)")
def least_squares_residual(s, d):
    """A^T (A x - b) of the least-squares solution."""
    rows = table(s, d, "embeddings")
    x = dense.least_squares(rows, "embedding", "label", N)
    error = F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), F.array(*[F.lit(float(v)) for v in x]), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v) - F.col("label").cast("double")
    cells = rows.withColumn("r", error).select(F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "x"), "r")
    return cells.groupBy(F.col("j").cast("long").alias("j")).agg((F.round(F.sum(F.col("x") * F.col("r")), 5) + F.lit(0.0)).alias("v"))


@query("nonnegative_least_squares", "SELECT true AS nonnegative, true AS stationary, true AS feasible")
def nonnegative_least_squares(s, d):
    """The conditions of an optimum: x >= 0, no gain by raising an entry, none by moving a positive one."""
    rows = table(s, d, "embeddings")
    both = rows.select(F.concat(F.col("embedding").cast("array<double>"), F.array(F.col("label").cast("double"))).alias("row"))
    g = dense.gram_arrays(both, "row", N + 1)
    x = dense.nnls(rows, "embedding", "label", N)
    gain = g[:N, N] - g[:N, :N] @ x
    return s.createDataFrame([(bool((x >= 0).all()), bool(np.abs(gain[x > 1e-9]).max(initial=0) < 1e-6), bool(gain.max() < 1e-6))], "nonnegative boolean, stationary boolean, feasible boolean")


@query("levenberg_marquardt_fit", "SELECT 2.0::DOUBLE AS a, 0.5::DOUBLE AS b, 0.0::DOUBLE AS cost")
def levenberg_marquardt_fit(s, d):
    """y = a exp(b x) fitted to values that follow it with a = 2, b = 0.5."""
    x = F.col("p_retailprice") / 1000
    df = table(s, d, "part").select(x.alias("x"), (2 * F.exp(0.5 * x)).alias("y"))
    p, _, cost = fit.levenberg_marquardt(df, lambda p: p[0] * F.exp(p[1] * F.col("x")) - F.col("y"), [1.0, 1.0])
    return s.createDataFrame([(round(float(p[0]), 6), round(float(p[1]), 6), round(cost, 6) + 0.0)], "a double, b double, cost double")


@query("hybrid_root", "SELECT round(avg(s_acctbal), 4) AS x, round(stddev_pop(s_acctbal), 4) AS y FROM supplier")
def hybrid_root(s, d):
    """The root of a system whose solution is the mean and the deviation of a column."""
    n, total, squares = table(s, d, "supplier").agg(F.count("*"), F.sum("s_acctbal"), F.sum(F.col("s_acctbal") * F.col("s_acctbal"))).first()
    mean, square = total / n / 1000, squares / n / 1e6
    x = fit.hybrid_root(lambda p: np.array([p[0] - mean, p[1] * p[1] + p[0] * p[0] - square]), [1.0, 1.0])
    return s.createDataFrame([(round(float(x[0]) * 1000, 4), round(abs(float(x[1])) * 1000, 4))], "x double, y double")


@query("umeyama_fit", "SELECT * FROM (VALUES (0, 0.0, 3.0, 1.0), (1, -3.0, 0.0, 2.0), (2, 0.0, 0.0, 1.0)) t(i, a, b, c)")
def umeyama_fit(s, d):
    """The similarity that points of the suppliers were moved by."""
    x, y = F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double")
    pairs = table(s, d, "supplier").select(x.alias("a"), y.alias("b"), (3 * y + 1).alias("c"), (-3 * x + 2).alias("d"))
    m = fit.umeyama(pairs, ["a", "b"], ["c", "d"])
    return s.createDataFrame([(k, *(round(float(v), 6) + 0.0 for v in r)) for k, r in enumerate(m)], "i int, a double, b double, c double")


@query("polynomial_roots", "SELECT CAST(r_regionkey AS BIGINT) AS k, CAST(r_regionkey AS DOUBLE) AS re, 0.0::DOUBLE AS im FROM region")
def polynomial_roots(s, d):
    """The roots of the polynomial that has the regions' keys as roots."""
    keys = sorted(float(r[0]) for r in table(s, d, "region").select("r_regionkey").collect())  # five rows
    w = kernels.companion_roots(kernels.monic_polynomial(np.array(keys)))
    return s.createDataFrame([(k, round(float(z.real), 5) + 0.0, round(abs(float(z.imag)), 5)) for k, z in enumerate(w)], "k long, re double, im double")


M_SQL = f"{E_SQL}, m AS (SELECT j, avg(v) AS v FROM e GROUP BY j)"


def _means(s, d):
    """The mean vector: 64 numbers on the driver."""
    m = {r["j"]: r["m"] for r in table(s, d, "embeddings").select(F.posexplode("embedding").alias("j", "v")).groupBy("j").agg(F.avg(F.col("v").cast("double")).alias("m")).collect()}
    return np.array([m[k] for k in range(N)])


@query("toeplitz_product", f"WITH {M_SQL} SELECT a.range AS i, round(sum(m.v / (1 + abs(a.range - m.j))), 6) + 0.0 AS v FROM range(64) a, m GROUP BY a.range")
def toeplitz_product(s, d):
    c = 1 / (1 + np.arange(float(N)))
    y = kernels.toeplitz_apply(c, c, _means(s, d))
    return s.createDataFrame([(k, round(float(x), 6) + 0.0) for k, x in enumerate(y)], "i long, v double")


@query("toeplitz_solve", f"WITH {M_SQL} SELECT j AS i, round(v, 6) + 0.0 AS v FROM m")
def toeplitz_solve(s, d):
    c = 1 / (1 + np.arange(float(N)))
    y = kernels.levinson(c, c, kernels.toeplitz_apply(c, c, _means(s, d)))
    return s.createDataFrame([(k, round(float(x), 6) + 0.0) for k, x in enumerate(y)], "i long, v double")


@query("spline_through_points", f"WITH {M_SQL} SELECT j AS i, round(v, 6) + 0.0 AS v FROM m")
def spline_through_points(s, d):
    """A cubic spline through 64 points, evaluated where it must meet them."""
    points = np.stack([np.arange(float(N)), _means(s, d)], 1)
    u, knots, control = kernels.spline_interpolate(points, 3)
    return s.createDataFrame([(k, round(float(kernels.spline_eval(x, 3, knots, control)[1]), 6) + 0.0) for k, x in enumerate(u)], "i long, v double")


@query("power_iteration", "SELECT true AS is_eigenvalue, true AS largest")
def power_iteration(s, d):
    """The value found is an eigenvalue (its residual vanishes), and the largest: the rest of the spectrum, by the trace of the square, is no larger."""
    a = dense.gram_arrays(table(s, d, "embeddings"), "embedding", N) + np.eye(N)  # 64 x 64 numbers
    value, x = solvers.power_iteration(lambda y: a @ y, N)
    rest = a - value * np.outer(x, x)
    other, _ = solvers.power_iteration(lambda y: rest @ y, N, tolerance=1e-6)
    return s.createDataFrame([(bool(np.linalg.norm(a @ x - value * x) < 1e-4 * value), bool(abs(other) <= value * (1 + 1e-9)))], "is_eigenvalue boolean, largest boolean")


@query("lanczos_extremes", "SELECT true AS low, true AS high")
def lanczos_extremes(s, d):
    """Both ends of the spectrum of a distributed operator, against the dense solver."""
    a = _spd(s, d)
    w = [r["v"] for r in dense.factor(a, "eigh").where("part = 'S'").orderBy("i").collect()]
    with solvers.Operator(a) as op:
        found, _ = solvers.lanczos(op.apply, N, N, steps=N)
    return s.createDataFrame([(bool(np.allclose(found[:2], w[:2], rtol=1e-6)), bool(np.allclose(found[-2:], w[-2:], rtol=1e-6)))], "low boolean, high boolean")


# ---- Krylov solvers on distributed operators: the solution is known

X_SQL = "SELECT range AS i, range + 1.0::DOUBLE AS v FROM range(64)"


def _system(s, d, symmetric: bool):
    """I + 8 G / trace(G), with a skew part unless symmetric, and its product with 1, 2, ..., 64."""
    a = _scaled(s, d) + Matrix.identity(s, N)
    if not symmetric:
        a = a.map_indexed(lambda i, j, v: v + (j - i) / 640.0)
    op = solvers.Operator(Matrix(s.createDataFrame(a.df.toArrow()), N, N))  # 64 x 64 cells, made once
    return op, op.apply(np.arange(1.0, N + 1))


def _solution(s, x):
    return s.createDataFrame([(k, round(float(v), 4) + 0.0) for k, v in enumerate(x)], "i long, v double")


def _register_solver(name, solve, symmetric):
    @query(f"solve_{name}", X_SQL)
    def run(s, d):
        op, b = _system(s, d, symmetric)
        with op:
            got = solve(op, b)
        if not got.converged:
            raise ArithmeticError(f"{name} has not converged")
        return _solution(s, got.x)


_HOW = {"tolerance": 1e-9, "max_iterations": 200}
for _name, _solve, _symmetric in (
    ("conjugate_gradient", lambda op, b: solvers.conjugate_gradient(op.apply, b, solvers.jacobi(op.diagonal()), **_HOW), True),
    ("conjugate_gradient_incomplete_cholesky", lambda op, b: solvers.conjugate_gradient(op.apply, b, solvers.incomplete_cholesky(op.columns()), **_HOW), True),
    ("minres", lambda op, b: solvers.minres(op.apply, b, **_HOW), True),
    ("bicgstab", lambda op, b: solvers.bicgstab(op.apply, b, **_HOW), False),
    ("bicgstab_incomplete_lu", lambda op, b: solvers.bicgstab(op.apply, b, solvers.incomplete_lu(op.columns(), 1e-3), **_HOW), False),
    ("bicgstab_l", lambda op, b: solvers.bicgstab_l(op.apply, b, 2, **_HOW), False),
    ("gmres", lambda op, b: solvers.gmres(op.apply, b, **_HOW), False),
    ("dgmres", lambda op, b: solvers.dgmres(op.apply, b, 10, 2, **_HOW), False),
    ("idrs", lambda op, b: solvers.idrs(op.apply, b, 4, **_HOW), False),
    ("idrstab", lambda op, b: solvers.idrstab(op.apply, b, 4, 2, **_HOW), False),
    ("least_squares_conjugate_gradient", lambda op, b: solvers.lscg(op, b, preconditioner=solvers.least_squares_diagonal(op), **_HOW), False),
    ("lsmr", lambda op, b: solvers.lsmr(op, b, **_HOW), False),
):
    _register_solver(_name, _solve, _symmetric)


# ---- sparse direct solvers: a system over all customers of known solution

C_SQL = "SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS i, CAST(0 AS BIGINT) AS j, 1.0 + (c_custkey - (SELECT min(c_custkey) FROM customer)) % 7 AS v FROM customer"


def _chain(s, d, symmetric: bool = True, lower: float = -1.0):
    """(matrix, truth): neighbours in order of key are coupled; the diagonal comes from the balances."""
    customers = table(s, d, "customer")
    first, last = customers.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    n = int(last - first + 1)
    k = (F.col("c_custkey") - first).cast("long")
    arms = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), w.alias("w")) for o, w in ((0, 4 + F.col("c_acctbal") / 10_000), (-1, F.lit(lower)), (1, F.lit(-1.0 if symmetric else -0.5)))])).alias("t")
    cells = customers.select(k.alias("i"), arms).select("i", (F.col("i") + F.col("t.o")).alias("j"), F.col("t.w").alias("v")).where((F.col("j") >= 0) & (F.col("j") < n))
    truth = customers.select(k.alias("i"), F.lit(0).cast("long").alias("j"), (1.0 + k % 7).alias("v"))
    return Matrix(cells, n, n), Matrix(truth, n, 1)


def _solved(x: Matrix):
    return x.df.select("i", "j", (F.round("v", 5) + F.lit(0.0)).alias("v"))


def _register_direct(kind, symmetric):
    @query(f"sparse_{kind}_solve", C_SQL)
    def run(s, d):
        a, x = _chain(s, d, symmetric)
        return _solved(sparse_direct.solve(a, a @ x, kind))


for _kind, _symmetric in (("llt", True), ("ldlt", True), ("lu", False), ("qr", False)):
    _register_direct(_kind, _symmetric)


@query("sparse_triangular_solve", C_SQL)
def sparse_triangular_solve(s, d):
    a, x = _chain(s, d, False)
    return _solved(sparse_direct.solve(a, a.triangular("lower") @ x, "lower"))


@query("sparse_triangular_solve_by_levels", C_SQL)
def sparse_triangular_solve_by_levels(s, d):
    """Each row depends on the first of its ten: two levels, as DataFrames all the way."""
    customers = table(s, d, "customer")
    a, x = _chain(s, d)
    k = F.col("i")
    diagonal = a.df.where("i = j")
    head = x.df.select("i", (k - k % 10).alias("j"), F.lit(-0.5).alias("v")).where("i != j")
    t = Matrix(diagonal.unionByName(head), a.rows, a.cols)
    return _solved(sparse_direct.level_solve(t, t @ x)[0])


@query("sparse_inverse_diagonal", C_SQL.replace("1.0 + (c_custkey - (SELECT min(c_custkey) FROM customer)) % 7", "1.0::DOUBLE"))
def sparse_inverse_diagonal(s, d):
    """The diagonal of A times its selected inverse, whose entries on A's pattern are all that it takes."""
    a, _ = _chain(s, d)
    inverse = sparse_direct.factor(a, "inverse").where("part = 'V'").select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("v").alias("w"))
    both = a.df.join(inverse, ["i", "j"]).groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return both.select("i", F.lit(0).cast("long").alias("j"), r6("v").alias("v"))


@query("elimination_tree", "WITH n AS (SELECT max(c_custkey) - min(c_custkey) AS last FROM customer) SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS i, CASE WHEN c_custkey = (SELECT max(c_custkey) FROM customer) THEN -1.0::DOUBLE ELSE c_custkey - (SELECT min(c_custkey) FROM customer) + 1.0 END AS parent FROM customer, n")
def elimination_tree(s, d):
    """Of a chain: each column's parent is the next."""
    return sparse_direct.factor(_chain(s, d)[0], "etree").select("i", F.col("v").alias("parent"))


@query("column_elimination_tree", "SELECT CAST(max(c_custkey) - min(c_custkey) + 1 AS BIGINT) AS n, CAST(1 AS BIGINT) AS roots, true AS upwards FROM customer")
def column_elimination_tree(s, d):
    tree = sparse_direct.factor(_chain(s, d, False)[0], "column_etree")
    return tree.agg(F.count("*").alias("n"), F.count_if(F.col("v") < 0).alias("roots"), F.bool_and((F.col("v") < 0) | (F.col("v") > F.col("i"))).alias("upwards"))


@query("fill_reducing_orders", "SELECT CAST(max(c_custkey) - min(c_custkey) + 1 AS BIGINT) AS n, CAST(max(c_custkey) - min(c_custkey) + 1 AS BIGINT) AS amd, CAST(max(c_custkey) - min(c_custkey) + 1 AS BIGINT) AS colamd, true AS no_fill FROM customer")
def fill_reducing_orders(s, d):
    """Both orders are permutations; minimum degree on a chain makes no fill: L has as many entries as the chain has links."""
    a, _ = _chain(s, d)
    orders = sparse_direct.factor(a, "amd").agg(F.count_distinct("v").alias("amd"), F.count("*").alias("n"))
    columns = sparse_direct.factor(a, "colamd").agg(F.count_distinct("v").alias("colamd"))
    fill = sparse_direct.factor(a, "ldlt").where("part = 'L' and i != j").agg((F.count("*") == a.rows - 1).alias("no_fill"))
    return orders.crossJoin(F.broadcast(columns)).crossJoin(F.broadcast(fill)).select("n", "amd", "colamd", "no_fill")
