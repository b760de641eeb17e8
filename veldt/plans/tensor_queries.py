"""Queries of element-wise functions, tensors, windows, geometry, spatial joins, decompositions and solvers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from veldt.functions import elementwise as E
from veldt.functions import geometry as G
from veldt.functions import special
from veldt.operators import dense, fit, spatial
from veldt.operators.matrix import Matrix
from veldt.operators.tensor import Tensor
from veldt.plans._register import E_SQL, embeddings, query, r6, table

def v():
    return F.col("v")
EW = f"WITH {E_SQL}"


def _values(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") / 1000).alias("x"), (F.col("p_size") - 25).cast("long").alias("n"))


P_SQL = "p AS (SELECT p_partkey AS k, p_retailprice / 1000 AS x, CAST(p_size - 25 AS BIGINT) AS n FROM part)"
#: name -> DuckDB expression of x
UNARY_SQL = {
    "exp": "exp(x)", "exp2": "pow(2.0, x)", "expm1": "exp(x) - 1", "log": "ln(x)", "log1p": "ln(1 + x)", "log10": "log10(x)", "log2": "log2(x)", "sqrt": "sqrt(x)", "cbrt": "cbrt(x)", "rsqrt": "1 / sqrt(x)", "inverse": "1 / x",
    "square": "x * x", "cube": "x * x * x", "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "atan": "atan(x)", "sinh": "(exp(x) - exp(-x)) / 2", "cosh": "(exp(x) + exp(-x)) / 2", "tanh": "(exp(x) - exp(-x)) / (exp(x) + exp(-x))",
    "asinh": "ln(x + sqrt(x * x + 1))", "logistic": "1 / (1 + exp(-x))", "sign": "CAST(sign(x) AS DOUBLE)", "abs": "abs(x)", "negate": "-x", "rint": "round_even(x, 0)", "floor": "floor(x)", "ceil": "ceil(x)", "trunc": "trunc(x)", "round": "round(x)",
}


@query("elementwise_math", f"WITH {P_SQL} SELECT k, {', '.join(f'round({e}, 6) + 0.0 AS f_{n}' for n, e in UNARY_SQL.items())} FROM p")
def elementwise_math(s, d):
    return _values(s, d).select("k", *[r6(E.UNARY[n](F.col("x")).cast("double")).alias(f"f_{n}") for n in UNARY_SQL])


@query("elementwise_domain", f"WITH {P_SQL}, y AS (SELECT k, x / 3 AS y FROM p WHERE x <= 3) SELECT k, round(asin(y), 6) AS a, round(acos(y), 6) AS b, round(0.5 * ln((1 + y) / (1 - y)), 6) AS c, round(ln(1 / y + sqrt(1 / (y * y) - 1)), 6) AS e FROM y WHERE y < 1")
def elementwise_domain(s, d):
    y = _values(s, d).where("x <= 3").select("k", (F.col("x") / 3).alias("y")).where("y < 1")
    return y.select("k", r6(F.asin("y")).alias("a"), r6(F.acos("y")).alias("b"), r6(F.atanh("y")).alias("c"), r6(F.acosh(1 / F.col("y"))).alias("e"))


@query("ieee_guards", "SELECT true AS log_zero, true AS log_negative, true AS inverse_zero, false AS nan_equal, true AS nan_differs, -3.0::DOUBLE AS rounded, 2.0::DOUBLE AS rinted")
def ieee_guards(s, d):
    zero, nan = F.col("id") * 0.0, F.col("id") * 0.0 + F.lit(float("nan"))
    return s.range(1).select(
        (E.UNARY["log"](zero) == F.lit(-E.INF)).alias("log_zero"), F.isnan(E.UNARY["log"](zero - 1)).alias("log_negative"), (E.UNARY["inverse"](zero + 0.0) .isNotNull()).alias("inverse_zero"),
        E.BINARY["eq"](nan, nan).alias("nan_equal"), E.BINARY["ne"](nan, nan).alias("nan_differs"), E.UNARY["round"](zero - 2.5).alias("rounded"), E.UNARY["rint"](zero + 2.5).alias("rinted"),
    )


@query("binary_math", f"WITH {P_SQL} SELECT k, round(x + n, 6) + 0.0 AS a, round(x - n, 6) + 0.0 AS b, round(x * n, 6) + 0.0 AS c, round(abs(x - n), 6) AS e, round(pow(x, 2.5), 6) AS f, round(atan2(x, n), 6) AS g, round(sqrt(x * x + n * n), 6) AS h, round(least(x, n), 6) AS lo, round(greatest(x, n), 6) AS hi, round(least(greatest(x, 1.1), 1.5), 6) AS clip, n % 7 AS m FROM p")
def binary_math(s, d):
    x, n = F.col("x"), F.col("n")
    y = n.cast("double")
    return _values(s, d).select("k", r6(E.BINARY["add"](x, y)).alias("a"), r6(E.BINARY["sub"](x, y)).alias("b"), r6(E.BINARY["mul"](x, y)).alias("c"), r6(E.BINARY["absolute_difference"](x, y)).alias("e"), r6(E.BINARY["pow"](x, F.lit(2.5))).alias("f"), r6(E.BINARY["atan2"](x, y)).alias("g"), r6(E.BINARY["hypot"](x, y)).alias("h"), r6(E.nan_min(x, y)).alias("lo"), r6(E.nan_max(x, y)).alias("hi"), r6(E.clip(x, 1.1, 1.5)).alias("clip"), E.BINARY["mod"](n, F.lit(7)).alias("m"))


@query("shifts_bitwise", f"WITH {P_SQL} SELECT k, (n + 100) << 3 AS l, (n + 100) >> 2 AS r, (n + 100) & 13 AS a, (n + 100) | 13 AS o, xor(n + 100, CAST(13 AS BIGINT)) AS x, ~(n + 100) AS c FROM p")
def shifts_bitwise(s, d):
    n = F.col("n") + 100
    b = F.lit(13).cast("long")
    return _values(s, d).select("k", E.shift_left(n, 3).alias("l"), E.shift_right_arithmetic(n, 2).alias("r"), E.BINARY["bitand"](n, b).alias("a"), E.BINARY["bitor"](n, b).alias("o"), E.BINARY["bitxor"](n, b).alias("x"), E.UNARY["bitwise_not"](n).alias("c"))


@query("comparisons", f"WITH {P_SQL} SELECT k, x < 1.2 AS lt, x <= 1.2 AS le, x > 1.2 AS gt, x >= 1.2 AS ge, n = 0 AS eq, n <> 0 AS ne, CAST(CAST(x > 1.2 AS INT) AS DOUBLE) AS typed FROM p")
def comparisons(s, d):
    x, c, n = F.col("x"), F.lit(1.2), F.col("n")
    return _values(s, d).select("k", *[E.BINARY[o](x, c).alias(o) for o in ("lt", "le", "gt", "ge")], *[E.BINARY[o](n, F.lit(0)).alias(o) for o in ("eq", "ne")], E.typed(E.BINARY["gt"])(x, c).alias("typed"))


@query("lgamma", f"WITH {P_SQL} SELECT k, round(lgamma(x + 0.5), 6) + 0.0 AS v FROM p")
def lgamma(s, d):
    return _values(s, d).select("k", r6(special.function("lgamma")(F.col("x") + 0.5)).alias("v"))


@query("horner_poly", f"WITH {P_SQL} SELECT k, round(1 + 3 * x * x - 0.5 * x * x * x, 6) + 0.0 AS v FROM p")
def horner_poly(s, d):
    return _values(s, d).select("k", r6(E.horner(F.array(*[F.lit(c) for c in (1.0, 0.0, 3.0, -0.5)]), F.col("x"))).alias("v"))


def _series(s, d):
    """Users' events in time order as a rank-2 tensor (user, place)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = table(s, d, "events").select(F.col("user_id").alias("d0"), (F.row_number().over(w) - 1).cast("long").alias("d1"), F.col("value").alias("v"))
    return Tensor(df, (1 << 40, 1 << 20))


S_SQL = "s AS (SELECT user_id AS d0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS d1, value AS v FROM events)"


def _out(t):
    return t.df.select(*t.names, r6(v()).alias("v"))


@query("cumsum_user_events", f"WITH {S_SQL} SELECT d0, d1, round(sum(v) OVER (PARTITION BY d0 ORDER BY d1), 6) + 0.0 AS v FROM s")
def cumsum_user_events(s, d):
    return _out(_series(s, d).cumsum(1, stored=True))


@query("cumsum_exclusive", f"WITH {S_SQL} SELECT d0, d1, round(coalesce(sum(v) OVER (PARTITION BY d0 ORDER BY d1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) + 0.0 AS v FROM s")
def cumsum_exclusive(s, d):
    return _out(_series(s, d).cumsum(1, exclusive=True, stored=True))


@query("convolve_1d_events", f"WITH {S_SQL} SELECT d0, d1, round(0.25 * v + 0.5 * b + 0.25 * c, 6) + 0.0 AS v FROM (SELECT *, lead(v, 1) OVER w AS b, lead(v, 2) OVER w AS c FROM s WINDOW w AS (PARTITION BY d0 ORDER BY d1)) WHERE c IS NOT NULL")
def convolve_1d_events(s, d):
    t = _series(s, d)
    n = t.df.groupBy("d0").agg(F.max("d1").alias("last"))
    return _out(Tensor(t.convolve([0.25, 0.5, 0.25], [1]).df.join(n, "d0").where("d1 + 2 <= last").drop("last"), t.dims))


R = "round(v, 6) + 0.0 AS v"


# ---- geometry and spatial joins


@query("quaternion_rotate", f"WITH {P_SQL} SELECT k, round(cos(x) * 1 - sin(x) * 2, 6) + 0.0 AS a, round(sin(x) * 1 + cos(x) * 2, 6) + 0.0 AS b, 3.0::DOUBLE AS c FROM p")
def quaternion_rotate(s, d):
    axis = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    p = G.q_rotate(G.q_from_axis_angle(axis, F.col("x")), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return _values(s, d).select("k", p.alias("p")).select("k", r6(F.col("p")[0]).alias("a"), r6(F.col("p")[1]).alias("b"), r6(F.col("p")[2]).alias("c"))


@query("euler_round_trip", f"WITH {P_SQL} SELECT k, round(x / 3, 6) AS z, round(x / 4, 6) AS y, round(x / 5, 6) AS x FROM p")
def euler_round_trip(s, d):
    x = F.col("x")
    return _values(s, d).select("k", G.euler_angles(G.from_euler(x / 3, x / 4, x / 5)).alias("a")).select("k", *[r6(F.col("a")[n]).alias(c) for n, c in enumerate("zyx")])


@query("det3x3", "SELECT vec_id, round(a[1] * (a[5] * a[9] - a[6] * a[8]) - a[2] * (a[4] * a[9] - a[6] * a[7]) + a[3] * (a[4] * a[8] - a[5] * a[7]), 6) + 0.0 AS det FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings)")
def det3x3(s, d):
    a = F.transform("embedding", lambda x: x.cast("double"))
    return table(s, d, "embeddings").select("vec_id", a.alias("a")).select("vec_id", r6(G.det3(F.col("a"))).alias("det"))


@query("box_bounds", f"{EW} SELECT j, round(min(v), 6) + 0.0 AS low, round(max(v), 6) + 0.0 AS high FROM e GROUP BY j")
def box_bounds(s, d):
    return embeddings(s, d).colwise(low=r6(F.min("v")), high=r6(F.max("v")))


@query("plane_distance", "SELECT vec_id, round((a[1] + 2 * a[2] + 2 * a[3]) / 3 + 0.5, 6) + 0.0 AS dist FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings)")
def plane_distance(s, d):
    normal = F.array(*[F.lit(x / 3) for x in (1.0, 2.0, 2.0)])
    p = F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 3)
    return table(s, d, "embeddings").select("vec_id", r6(G.plane_signed_distance(normal, F.lit(0.5), p)).alias("dist"))


def _points(s, d, name, key, a, b):
    return table(s, d, name).select(F.col(key).alias("id"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))


@query("spatial_overlap_join", "WITH c AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y, 0.3 AS r FROM customer), s AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, CAST(s_nationkey AS DOUBLE) AS y, 0.5 AS r FROM supplier) SELECT c.id AS a, s.id AS b FROM c JOIN s ON (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) <= (c.r + s.r) * (c.r + s.r)")
def spatial_overlap_join(s, d):
    """Radii are decimals, as in the SQL: the square of their sum is 0.64, that of the doubles a little more."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.lit(Decimal("0.3")).alias("r"))
    t = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.lit(Decimal("0.5")).alias("r"))
    return spatial.overlapping_pairs(c, t, ["x", "y"], 1.0)


@query("nearest_neighbour", "WITH c AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer), s AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier) SELECT a, b, round(g, 6) AS distance FROM (SELECT c.id AS a, s.id AS b, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS g, row_number() OVER (PARTITION BY c.id ORDER BY sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)), s.id) AS r FROM c, s) WHERE r = 1")
def nearest_neighbour(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    t = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return spatial.nearest(c, t, ["x", "y"], 4.0).select("a", "b", r6("distance").alias("distance"))


@query("chord_lengths", f"WITH {S_SQL}, g AS (SELECT *, coalesce(abs(v - lag(v) OVER (PARTITION BY d0 ORDER BY d1)), 0) AS g FROM s) SELECT d0, d1, round(sum(g) OVER (PARTITION BY d0 ORDER BY d1), 6) + 0.0 AS v FROM g")
def chord_lengths(s, d):
    t = _series(s, d)
    step = F.coalesce(F.abs(v() - F.lag("v").over(Window.partitionBy("d0").orderBy("d1"))), F.lit(0.0))
    return _out(Tensor(t.df.withColumn("v", step), t.dims).cumsum(1, stored=True))


# ---- decompositions, solvers, matrix functions (rows only, tested against NumPy)


def _spd(s, d):
    g = embeddings(s, d).gram()
    return g + Matrix.identity(s, 64)


@query("solve_round_trip", "SELECT range AS i, CAST(0 AS BIGINT) AS j, range + 1.0 AS v FROM range(64)")
def solve_round_trip(s, d):
    a = _spd(s, d)
    x = dense.solve(a, a @ Matrix.linspaced(s, 64, 1.0, 64.0), "llt")
    return x.df.select("i", "j", F.round("v", 4).alias("v"))


@query("inverse_times_matrix", "SELECT a.range AS i, b.range AS j, CASE WHEN a.range = b.range THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM range(64) a, range(64) b")
def inverse_times_matrix(s, d):
    a = _spd(s, d)
    return (dense.matrix_function(a, "inverse") @ a).df.select("i", "j", (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query("cholesky_reconstructed", f"{EW}, g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM e a JOIN e b USING (i) GROUP BY a.j, b.j) SELECT i, j, round(v + CASE WHEN i = j THEN 1 ELSE 0 END, 5) + 0.0 AS v FROM g")
def cholesky_reconstructed(s, d):
    f = dense.factor(_spd(s, d), "llt")
    low = Matrix(f.where("part = 'L'").select("i", "j", "v"), 64, 64)
    return (low @ low.transpose()).df.select("i", "j", (F.round("v", 5) + F.lit(0.0)).alias("v"))


@query("svd_energy", f"{EW} SELECT round(sum(v * v), 4) AS total FROM e")
def svd_energy(s, d):
    """The squared singular values, from R of a tree QR, add up to the squared norm."""
    r = Matrix(dense.tsqr_r(table(s, d, "embeddings"), "embedding", 64), 64, 64)
    return dense.factor(r, "svd").where("part = 'S'").agg(F.round(F.sum(v() * v()), 4).alias("total"))


@query("matrix_sqrt_squared", f"{EW}, g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM e a JOIN e b USING (i) GROUP BY a.j, b.j) SELECT i, j, round(v + CASE WHEN i = j THEN 1 ELSE 0 END, 4) + 0.0 AS v FROM g")
def matrix_sqrt_squared(s, d):
    root = dense.matrix_function(_spd(s, d), "operator_sqrt")
    return (root @ root).df.select("i", "j", (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query("autodiff_columns", f"WITH {P_SQL} SELECT k, round(x * exp(x / 10), 6) AS val, round(exp(x / 10) + x * exp(x / 10) / 10, 6) AS grad FROM p")
def autodiff_columns(s, d):
    (x,) = fit.Dual.variables(F.col("x"))
    y = x * (x / 10.0).exp()
    return _values(s, d).select("k", r6(y.value).alias("val"), r6(y.grad[0]).alias("grad"))


A_SQL = """n AS (SELECT CAST(max(vec_id) + 1 AS BIGINT) AS n FROM embeddings),
c AS (SELECT (k - 1) % 4 AS d0, (k - 1) // 4 % 4 AS d1, (k - 1) // 16 AS d2, vec_id AS d3, v FROM (SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"""


def _cubes(s, d):
    n = table(s, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    e = embeddings(s, d)
    return Tensor(e.df.select(F.col("j").alias("d0"), F.col("i").alias("d1"), "v"), (64, n)).reshape((4, 4, 4, n))


@query("tensor_slice", f"WITH {A_SQL} SELECT d0 - 1 AS d0, d1, d2 - 2 AS d2, d3, {R} FROM c WHERE d0 BETWEEN 1 AND 2 AND d1 < 3 AND d2 >= 2")
def tensor_slice(s, d):
    c = _cubes(s, d)
    return _out(c.slice((1, 0, 2, 0), (2, 3, 2, c.dims[3])))


@query("tensor_strided_slice", f"WITH {A_SQL} SELECT d0 // 2 AS d0, 3 - d1 AS d1, d2, d3, {R} FROM c WHERE d0 % 2 = 0 AND d1 > 0")
def tensor_strided_slice(s, d):
    c = _cubes(s, d)
    return _out(c.strided_slice((0, 3, 0, 0), (4, 0, 4, c.dims[3]), (2, -1, 1, 1)))


@query("chip", f"WITH {A_SQL} SELECT d0, d2 AS d1, d3 AS d2, {R} FROM c WHERE d1 = 2")
def chip(s, d):
    return _out(_cubes(s, d).chip(1, 2))


@query("roll", f"WITH {A_SQL} SELECT (d0 + 3) % 4 AS d0, d1, (d2 + 2) % 4 AS d2, (d3 + n - 3) % n AS d3, {R} FROM c, n")
def roll(s, d):
    return _out(_cubes(s, d).roll((1, 0, 2, 3)))


@query("tensor_reverse", f"WITH {A_SQL} SELECT 3 - d0 AS d0, d1, 3 - d2 AS d2, n - 1 - d3 AS d3, {R} FROM c, n")
def tensor_reverse(s, d):
    return _out(_cubes(s, d).reverse((True, False, True, True)))


@query("shuffle", f"WITH {A_SQL} SELECT d3 AS d0, d2 AS d1, d0 AS d2, d1 AS d3, {R} FROM c")
def shuffle(s, d):
    return _out(_cubes(s, d).shuffle((3, 2, 0, 1)))


@query("stride", f"WITH {A_SQL} SELECT d0 // 2 AS d0, d1, d2 // 3 AS d2, d3, {R} FROM c WHERE d0 % 2 = 0 AND d2 % 3 = 0")
def stride(s, d):
    return _out(_cubes(s, d).stride((2, 1, 3, 1)))


@query("inflate", f"WITH {A_SQL} SELECT d0 * 2 AS d0, d1 * 3 AS d1, d2, d3 * 2 AS d3, {R} FROM c")
def inflate(s, d):
    return _out(_cubes(s, d).inflate((2, 3, 1, 2)))


@query("pad", f"WITH {A_SQL}, w AS (SELECT unnest(range((SELECT n + 2 FROM n))) AS d3), g AS (SELECT a.range AS d0, b.range AS d1, z.range AS d2, w.d3 FROM range(6) a, range(4) b, range(5) z, w) SELECT g.d0, g.d1, g.d2, g.d3, round(coalesce(c.v, 9), 6) + 0.0 AS v FROM g LEFT JOIN c ON c.d0 = g.d0 - 1 AND c.d1 = g.d1 AND c.d2 = g.d2 AND c.d3 = g.d3")
def pad(s, d):
    return _out(_cubes(s, d).pad(((1, 1), (0, 0), (0, 1), (0, 2)), 9.0))


@query("tensor_broadcast", f"WITH {A_SQL} SELECT d0 + 4 * a.range AS d0, d1, d2 + 4 * b.range AS d2, d3 + n * z.range AS d3, {R} FROM c, n, range(2) a, range(3) b, range(2) z")
def tensor_broadcast(s, d):
    return _out(_cubes(s, d).broadcast((2, 1, 3, 2)))


@query("tensor_concatenate", f"WITH {A_SQL} SELECT d0, d1, d2, d3, {R} FROM c UNION ALL SELECT d0, d1, d2, d3 + n, {R} FROM c, n")
def tensor_concatenate(s, d):
    c = _cubes(s, d)
    return _out(c.concatenate(c, 3))


@query("index_pairs", f"WITH {A_SQL} SELECT d0 + 4 * d1 + 16 * d2 + 64 * d3 AS index, {R} FROM c")
def index_pairs(s, d):
    return _cubes(s, d).index_pairs().select("index", r6(v()).alias("v"))


@query("tensor_reduce_dims", f"WITH {A_SQL} SELECT d1 AS d0, d3 AS d1, round(sum(v), 6) + 0.0 AS total, round(max(v), 6) + 0.0 AS high, round(sum(v) / 16, 6) + 0.0 AS mean FROM c GROUP BY c.d1, c.d3")
def tensor_reduce_dims(s, d):
    c = _cubes(s, d)
    a, b, m = (f([0, 2]).df.withColumnRenamed("v", n) for f, n in ((c.sum, "total"), (c.maximum, "high"), (c.mean, "mean")))
    return a.join(b, ["d0", "d1"]).join(m, ["d0", "d1"]).select("d0", "d1", *[r6(n).alias(n) for n in ("total", "high", "mean")])


@query("tensor_argmax", f"WITH {A_SQL} SELECT d0, d2 AS d1, d3 AS d2, arg_max(d1, v) AS v FROM c GROUP BY c.d0, c.d2, c.d3")
def tensor_argmax(s, d):
    return _cubes(s, d).arg_extreme(1).df


@query("tensor_argmax_flat", f"WITH {A_SQL} SELECT d0 + 4 * d1 + 16 * d2 + 64 * d3 AS v FROM c ORDER BY c.v DESC, 1 LIMIT 1")
def tensor_argmax_flat(s, d):
    return _cubes(s, d).arg_extreme()


@query("tensor_trace", f"WITH {A_SQL} SELECT d2 AS d0, d3 AS d1, round(sum(v), 6) + 0.0 AS v FROM c WHERE c.d0 = c.d1 GROUP BY c.d2, c.d3")
def tensor_trace(s, d):
    return _out(_cubes(s, d).trace((0, 1)))


@query("tensor_cumsum", f"WITH {A_SQL} SELECT d0, d1, d2, d3, round(sum(v) OVER (PARTITION BY d0, d1, d3 ORDER BY d2), 6) + 0.0 AS v FROM c")
def tensor_cumsum(s, d):
    return _out(_cubes(s, d).cumsum(2))


@query("convolve_2d", f"WITH {A_SQL}, k AS (SELECT * FROM (VALUES (0, 0, 1.0), (0, 1, 2.0), (1, 0, -1.0), (1, 1, 0.5)) t(p, q, w)) SELECT d0 - p AS d0, d1 - q AS d1, d2, d3, round(sum(v * CAST(w AS DOUBLE)), 6) + 0.0 AS v FROM c, k WHERE d0 - p BETWEEN 0 AND 2 AND d1 - q BETWEEN 0 AND 2 GROUP BY ALL")
def convolve_2d(s, d):
    return _out(_cubes(s, d).convolve([[1.0, 2.0], [-1.0, 0.5]], (0, 1)))


@query("patches_2d", f"WITH {A_SQL} SELECT a.range AS d0, b.range AS d1, CAST(0 AS BIGINT) AS d2, CAST(0 AS BIGINT) AS d3, (d0 - a.range) + 3 * (d1 - b.range) + 9 * d2 + 36 * d3 AS d4, {R} FROM c, range(2) a, range(2) b WHERE c.d0 - a.range BETWEEN 0 AND 2 AND c.d1 - b.range BETWEEN 0 AND 2")
def patches_2d(s, d):
    return _out(_cubes(s, d).patches((2, 2, 1, 1)))


@query("image_patches", f"WITH {A_SQL} SELECT d2 AS d0, d3 AS d1, p.range AS d2, q.range AS d3, x.range + y.range * 2 AS d4, {R} FROM c, range(2) p, range(2) q, range(2) x, range(2) y WHERE c.d0 = x.range * 2 + p.range AND c.d1 = y.range * 2 + q.range")
def image_patches(s, d):
    return _out(_cubes(s, d).image_patches((0, 1), (2, 2), (2, 2)))


@query("contract_3way", f"WITH {A_SQL} SELECT a.d0, b.d2 AS d1, round(sum(a.v * b.v), 6) + 0.0 AS v FROM c a JOIN c b ON a.d1 = b.d0 AND a.d2 = b.d1 AND a.d3 = b.d3 GROUP BY a.d0, b.d2")
def contract_3way(s, d):
    c = _cubes(s, d)
    return _out(c.contract(c, [(1, 0), (2, 1), (3, 3)]))


@query("dft", f"{EW} SELECT k.range AS d0, i AS d1, round(sum(v * cos(2 * pi() * k.range * j / 64)), 6) + 0.0 AS re, round(sum(-v * sin(2 * pi() * k.range * j / 64)), 6) + 0.0 AS im FROM e, range(64) k GROUP BY k.range, i")
def dft(s, d):
    t = Tensor(embeddings(s, d).df.select(F.col("j").alias("d0"), F.col("i").alias("d1"), "v"), (64, 1 << 40))
    return t.fft([0]).select("d0", "d1", r6("re").alias("re"), r6("im").alias("im"))


@query("cumprod_series", f"WITH {S_SQL}, x AS (SELECT d0, d1, v / 50 AS x FROM s) SELECT d0, d1, CASE WHEN bool_or(x = 0) OVER w THEN 0 WHEN count(*) FILTER (x < 0) OVER w % 2 = 1 THEN -1 ELSE 1 END AS sign, round(sum(CASE WHEN x = 0 THEN 0 ELSE ln(abs(x)) END) OVER w, 6) + 0.0 AS log FROM x WINDOW w AS (PARTITION BY d0 ORDER BY d1)")
def cumprod_series(s, d):
    """Running products of whole series as sign and log of the magnitude (of the factors that aren't zero): no series is too long for a double."""
    t = _series(s, d).map(lambda x: x / 50)
    log = t.map(lambda x: F.when(x == 0, 0.0).otherwise(F.ln(F.abs(x)))).cumsum(1, stored=True).df.withColumnRenamed("v", "log")
    sign = t.map(lambda x: F.signum(x)).cumprod(1, stored=True).df.withColumnRenamed("v", "sign")
    return log.join(sign, ["d0", "d1"]).select("d0", "d1", F.col("sign").cast("int").alias("sign"), r6("log").alias("log"))
