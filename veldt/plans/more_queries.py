"""Queries of indexing, sparse semantics, reducers, scans, special functions, geometry, block-sparse matrices and files."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from veldt.functions import complex as C
from veldt.functions import elementwise as E
from veldt.functions import geometry as G
from veldt.functions import special
from veldt.operators import blas, spatial
from veldt.operators.blocks import BlockMatrix
from veldt.operators.index import last, seq, seq_n
from veldt.operators.matrix import Matrix, permutation_inverse, permutation_product, transpositions
from veldt.operators.tensor import Tensor
from veldt.plans._register import E_SQL, L_SQL, O_SQL, embeddings, lineitems, orders, query, r6, rounded, scratch, table

EW = f"WITH {E_SQL}"
NW = f"{EW}, n AS (SELECT CAST(max(vec_id) + 1 AS BIGINT) AS n FROM embeddings)"
P_SQL = "p AS (SELECT p_partkey AS k, p_retailprice / 1000 AS x, CAST(p_size - 25 AS BIGINT) AS n FROM part)"


def v():
    return F.col("v")


def _whole(s, d):
    """All vectors, with the extent counted."""
    return Matrix(embeddings(s, d).df, table(s, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1, 64)


def _values(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") / 1000).alias("x"), (F.col("p_size") - 25).cast("long").alias("n"))


# ---- indexing


@query("coeff", f"{EW} SELECT round(v, 6) + 0.0 AS v FROM e WHERE i = 3 AND j = 5")
def coeff(s, d):
    return embeddings(s, d).coeff(3, 5).select(r6("v").alias("v"))


@query("row_and_col", f"{EW} SELECT CAST(0 AS BIGINT) AS i, j, round(v, 6) + 0.0 AS v FROM e WHERE i = 7 UNION ALL SELECT i, CAST(64 AS BIGINT), round(v, 6) + 0.0 FROM e WHERE j = 9")
def row_and_col(s, d):
    m = _whole(s, d)
    return rounded(Matrix(m.row(7).df.unionByName(m.col(9).df.withColumn("j", F.lit(64).cast("long"))), m.rows, 65))


@query("head_segment_tail", f"{NW} SELECT i, j, round(v, 6) + 0.0 AS v FROM e WHERE j = 0 AND i < 10 UNION ALL SELECT i - 10, CAST(1 AS BIGINT), round(v, 6) + 0.0 FROM e WHERE j = 0 AND i BETWEEN 10 AND 29 UNION ALL SELECT i - n + 5, CAST(2 AS BIGINT), round(v, 6) + 0.0 FROM e, n WHERE j = 0 AND i >= n - 5")
def head_segment_tail(s, d):
    c = _whole(s, d).col(0)
    parts = [m.df.withColumn("j", F.lit(k).cast("long")) for k, m in enumerate((c.head(10), c.segment(10, 20), c.tail(5)))]
    return rounded(Matrix(parts[0].unionByName(parts[1]).unionByName(parts[2]), 20, 3))


@query("corners", f"{NW} SELECT i - n + 6 AS i, j, round(v, 6) + 0.0 AS v FROM e, n WHERE i >= n - 6 AND j < 4 UNION ALL SELECT i, j - 56, round(v, 6) + 0.0 FROM e WHERE i < 6 AND j >= 60")
def corners(s, d):
    m = _whole(s, d)
    return rounded(m.corner("bottom_left", 6, 4).hcat(m.corner("top_right", 6, 4)))


@query("symbolic_index", f"{NW}, r AS (SELECT range AS i FROM n, range(2000000) WHERE range < n AND range % 3 = 1 AND range <= n - 2), c AS (SELECT * FROM (VALUES (0, 63), (1, 61), (2, 59), (3, 31)) t(q, j)) SELECT CAST((i - 1) // 3 AS BIGINT) AS i, CAST(q AS BIGINT) AS j, round(v, 6) + 0.0 AS v FROM e JOIN r USING (i) JOIN c USING (j)")
def symbolic_index(s, d):
    """Every third row from 1 to last - 1, and columns last, last - 2, last - 4 and last // 2."""
    return rounded(_whole(s, d).indexed(seq(1, last - 1, 3), [last, last - 2, last - 4, last // 2]))


@query("reversed_sequence", f"{EW} SELECT i, CAST((62 - j) // 4 AS BIGINT) AS j, round(v, 6) + 0.0 AS v FROM e WHERE j % 4 = 2 AND j BETWEEN 2 AND 62")
def reversed_sequence(s, d):
    return rounded(_whole(s, d).indexed(None, seq_n(2, 16, 4).reverse()))


@query("conservative_resize", f"{EW} SELECT i, j, round(v, 6) + 0.0 AS v FROM e WHERE j < 40")
def conservative_resize(s, d):
    m = _whole(s, d)
    return rounded(m.conservative_resize(m.rows + 10, 40))


@query("insert_empty_cols", f"{EW} SELECT i, CASE WHEN j >= 20 THEN j + 3 ELSE j END AS j, round(v, 6) + 0.0 AS v FROM e")
def insert_empty_cols(s, d):
    return rounded(embeddings(s, d).insert_empty_cols(20, 3))


@query("as_diagonal", "SELECT c_custkey AS i, c_custkey AS j, round(c_acctbal, 6) + 0.0 AS v FROM customer")
def as_diagonal(s, d):
    c = Matrix(table(s, d, "customer").select(F.col("c_custkey").alias("i"), F.lit(0).cast("long").alias("j"), F.col("c_acctbal").alias("v")), 1 << 40, 1)
    return rounded(c.as_diagonal())


@query("cast_to_int", f"{EW} SELECT i, j, CAST(trunc(v * 100) AS DOUBLE) + 0.0 AS v FROM e")
def cast_to_int(s, d):
    return rounded(embeddings(s, d).scale(100.0).cast("int").cast("double"))


@query("reverse_one_axis", f"{NW} SELECT n - 1 - i AS i, j, round(v, 6) + 0.0 AS v FROM e, n UNION ALL SELECT i, 127 - j, round(v, 6) + 0.0 FROM e")
def reverse_one_axis(s, d):
    m = _whole(s, d)
    return rounded(m.reverse(cols=False).hcat(m.reverse(rows=False)))


# ---- construction


@query("constants", "SELECT a.range AS i, b.range AS j, 2.5::DOUBLE AS v FROM range(6) a, range(4) b UNION ALL SELECT a.range + 6, b.range, 1.0 FROM range(3) a, range(4) b UNION ALL SELECT CAST(11 AS BIGINT), CAST(0 AS BIGINT), 1.0")
def constants(s, d):
    """A constant matrix, ones and a unit vector below one another."""
    unit = Matrix.unit(s, 4, 2)
    return rounded(Matrix.constant(s, 6, 4, 2.5).vcat(Matrix.ones(s, 3, 4)).vcat(Matrix(unit.df, 4, 4)).vcat(Matrix.zero(s, 2, 4)))


@query("comma_values", "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(v AS DOUBLE) AS v FROM (VALUES (0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4), (0, 2, 5), (1, 3, 6)) t(i, j, v)")
def comma_values(s, d):
    return rounded(Matrix.values(s, [[1, 2], [3, 4]]).hcat(Matrix.from_csr(s, [0, 1, 2], [0, 1], [5, 6], 2)))


@query("triplets_first_and_largest", "SELECT user_id AS i, CAST(0 AS BIGINT) AS j, arg_min(value, event_id) AS v FROM events GROUP BY user_id UNION ALL SELECT user_id, CAST(1 AS BIGINT), max(value) FROM events GROUP BY user_id")
def triplets_first_and_largest(s, d):
    df = table(s, d, "events").select(F.col("user_id").alias("i"), F.lit(0).cast("long").alias("j"), F.col("value").alias("v"), "event_id")
    first = Matrix.from_triplets(df, 1 << 40, 1, "first", F.col("event_id"))
    return first.hcat(Matrix.from_triplets(df, 1 << 40, 1, F.max)).df


@query("insert_last_wins", f"WITH {O_SQL}, b AS (SELECT c_custkey AS i, CAST(0 AS BIGINT) AS j, c_acctbal AS w FROM customer) SELECT i, j, round(coalesce(w, v), 6) + 0.0 AS v FROM o FULL JOIN b USING (i, j)")
def insert_last_wins(s, d):
    batch = table(s, d, "customer").select(F.col("c_custkey").alias("i"), F.lit(0).cast("long").alias("j"), F.col("c_acctbal").alias("v"))
    return rounded(orders(s, d).insert_triplets(batch, "last"))


# ---- element-wise, sparse with dense


@query("scalar_arithmetic", f"WITH {O_SQL} SELECT i, j, round((2 * v + 1) / 3 - 5, 4) + 0.0 AS v FROM o")
def scalar_arithmetic(s, d):
    out = orders(s, d).map(lambda x: E.BINARY["sub"](E.BINARY["div"](E.BINARY["add"](E.BINARY["mul"](F.lit(2.0), x), F.lit(1.0)), F.lit(3.0)), F.lit(5.0)))
    return out.df.select("i", "j", (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query("unary_expression", f"{EW} SELECT i, j, round(v * (i - j), 6) + 0.0 AS v FROM e")
def unary_expression(s, d):
    return rounded(embeddings(s, d).map_indexed(lambda i, j, x: x * (i - j)))


@query("sparse_with_dense", f"WITH {O_SQL}, n AS (SELECT max(o_custkey) + 1 AS n FROM orders), g AS (SELECT a.range AS i, b.range AS j, 1.0 + b.range AS w FROM range((SELECT n FROM n)) a, range(5) b) SELECT i, j, round(coalesce(v, 0) + w, 4) + 0.0 AS v FROM g LEFT JOIN o USING (i, j)")
def sparse_with_dense(s, d):
    """A sparse matrix plus a dense one: every cell."""
    o = orders(s, d)
    n = table(s, d, "orders").agg(F.max("o_custkey")).first()[0] + 1
    dense = Matrix.generate(s, n, 5, lambda i, j: 1.0 + j)
    return (o + dense).df.select("i", "j", (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query("sparse_times_dense_cwise", f"WITH {O_SQL} SELECT i, j, round(v * (1 + j), 4) + 0.0 AS v FROM o")
def sparse_times_dense_cwise(s, d):
    n = table(s, d, "orders").agg(F.max("o_custkey")).first()[0] + 1
    dense = Matrix.generate(s, n, 5, lambda i, j: 1.0 + j)
    return orders(s, d).conjunction(dense).df.select("i", "j", (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query("boolean_and_select", f"{EW} SELECT i, j, (v > 0 AND j % 2 = 0) AS both, (v > 0 OR j % 2 = 0) AS either, ((v > 0) <> (j % 2 = 0)) AS one, NOT (v > 0) AS negated FROM e")
def boolean_and_select(s, d):
    a, b = v() > 0, F.col("j") % 2 == 0
    return embeddings(s, d).df.select("i", "j", E.BINARY["and"](a, b).alias("both"), E.BINARY["or"](a, b).alias("either"), E.BINARY["xor"](a, b).alias("one"), E.UNARY["not"](a).alias("negated"))


@query("select_between_matrices", f"WITH {O_SQL}, {L_SQL}, m AS (SELECT i, j FROM o WHERE v > 150000) SELECT o.i, o.j, round(CASE WHEN m.i IS NULL THEN -o.v ELSE o.v END, 4) + 0.0 AS v FROM o LEFT JOIN m USING (i, j)")
def select_between_matrices(s, d):
    o = orders(s, d)
    return o.map(lambda x: (x > 150_000).cast("double")).select(o, -o).df.select("i", "j", (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query("rounding_of_all_doubles", """
SELECT * FROM (VALUES ('nan', 'nan', 'nan', 'nan', 'nan'), ('inf', 'inf', 'inf', 'inf', 'inf'), ('-inf', '-inf', '-inf', '-inf', '-inf'), ('1e20', '1e+20', '1e+20', '1e+20', '1e+20'), ('-2.5', '-3', '-2', '-3', '-2'),
 ('0.49999999999999994', '0', '1', '0', '0'), ('2.5', '2', '3', '3', '2'), ('-0.4', '-1', '-0', '-0', '-0'), ('-0.0', '-0', '-0', '-0', '-0'), ('9007199254740993.0', '9007199254740992', '9007199254740992', '9007199254740992', '9007199254740992'), ('0.5', '0', '1', '1', '0')
) t(x, floor, ceil, round, trunc)""")
def rounding_of_all_doubles(s, d):
    """NaN, infinities, large values, halves and negative zeros."""
    names = ["nan", "inf", "-inf", "1e20", "-2.5", "0.49999999999999994", "2.5", "-0.4", "-0.0", "9007199254740993.0", "0.5"]
    rows = s.createDataFrame([(n, float(n)) for n in names], "x string, y double")
    out = rows.select("x", *[E.UNARY[n](F.col("y")).alias(n) for n in ("floor", "ceil", "round", "trunc")])

    def shown(c):
        # a double's own text tells a negative zero
        t = F.col(c).cast("string")
        return F.when(t == "NaN", "nan").when(t == "Infinity", "inf").when(t == "-Infinity", "-inf").when(t == "1.0E20", "1e+20").when(t == "9.007199254740992E15", "9007199254740992").otherwise(F.regexp_replace(t, r"\.0$", "")).alias(c)

    return out.select("x", *[shown(c) for c in ("floor", "ceil", "round", "trunc")])


@query("ldexp_and_clip", f"WITH {P_SQL} SELECT k, round(x * 8, 6) + 0.0 AS l, round(x / 4, 6) + 0.0 AS r, round(least(greatest(x, 1.2), 1.6), 6) AS c FROM p")
def ldexp_and_clip(s, d):
    x = F.col("x")
    return _values(s, d).select("k", r6(E.ldexp(x, 3)).alias("l"), r6(E.ldexp(x, -2)).alias("r"), r6(E.clip(x, 1.2, 1.6)).alias("c"))


@query("complex_arithmetic", f"WITH {P_SQL} SELECT k, round(x * n - x * n, 6) + 0.0 AS re, round(x * x + n * n, 6) + 0.0 AS im, round(x * x + n * n, 6) AS abs2, round(sqrt(x * x + n * n), 6) AS abs, round(atan2(n, x), 6) + 0.0 AS arg, round(exp(x) * cos(n), 6) + 0.0 AS exp_re, round(exp(x) * sin(n), 6) + 0.0 AS exp_im, round(x / sqrt(x * x + n * n), 6) + 0.0 AS sign_re, round(-n, 6) + 0.0 AS conj_im FROM p")
def complex_arithmetic(s, d):
    """z = x + n i and w = n + x i: their product, and functions of z."""
    z = _values(s, d).select("k", C.make(F.col("x"), F.col("n")).alias("z"), C.make(F.col("n"), F.col("x")).alias("w"))
    p, z = z.withColumn("p", C.mul(F.col("z"), F.col("w"))), F.col("z")
    return p.select("k", r6(F.col("p.re")).alias("re"), r6(F.col("p.im")).alias("im"), r6(C.abs2(z)).alias("abs2"), r6(C.absolute(z)).alias("abs"), r6(C.arg(z)).alias("arg"), r6(C.exp(z)["re"]).alias("exp_re"), r6(C.exp(z)["im"]).alias("exp_im"), r6(C.sign(z)["re"]).alias("sign_re"), r6(C.conj(z)["im"]).alias("conj_im"))


# ---- reductions with structural zeros

D_SQL = f"{O_SQL}, n AS (SELECT max(o_custkey) + 1 AS n FROM orders)"


def _debts(s, d):
    """Negative totals: where a cell is missing, its zero is the largest."""
    return Matrix((-orders(s, d)).df, table(s, d, "orders").agg(F.max("o_custkey")).first()[0] + 1, 5)


@query("sparse_row_extremes", f"WITH {D_SQL} SELECT i, round(CASE WHEN count(*) = 5 THEN max(-v) ELSE greatest(max(-v), 0) END, 4) + 0.0 AS max, round(CASE WHEN count(*) = 5 THEN min(-v) ELSE least(min(-v), 0) END, 4) + 0.0 AS min, round(sum(-v) / 5, 4) + 0.0 AS mean, count(*) = 5 AS all, true AS any, count(*) AS count FROM o GROUP BY i")
def sparse_row_extremes(s, d):
    out = _debts(s, d).rowwise("max", "min", "mean", "all", "any", "count")
    return out.select("i", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("max", "min", "mean")], "all", "any", "count")


@query("sparse_col_extremes", f"WITH {D_SQL} SELECT j, round(CASE WHEN count(*) = any_value(n) THEN max(-v) ELSE greatest(max(-v), 0) END, 4) + 0.0 AS max, round(min(-v), 4) + 0.0 AS min, round(sum(v * v) / 1e10, 6) AS squares FROM o, n GROUP BY j")
def sparse_col_extremes(s, d):
    out = _debts(s, d).colwise("max", "min", "squared_norm")
    return out.select("j", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("max", "min")], F.round(F.col("squared_norm") / 1e10, 6).alias("squares"))


S_SQL = f"WITH {D_SQL}, g AS (SELECT a.range AS i, b.range AS j FROM range((SELECT n FROM n)) a, range(5) b), f AS (SELECT g.i, g.j, coalesce(-v, 0) AS v FROM g LEFT JOIN o USING (i, j))"


@query("sparse_argmax_rows", f"{S_SQL} SELECT i, round(v, 4) + 0.0 AS v, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) AS r FROM f WHERE i IN (SELECT i FROM o)) WHERE r = 1")
def sparse_argmax_rows(s, d):
    """The largest entry of each row that has one; a missing cell is a zero, and the first of them wins."""
    return _debts(s, d).arg_extreme(True, "i", "row").select("i", (F.round("v", 4) + F.lit(0.0)).alias("v"), "j")


@query("sparse_argmax_cols", f"{S_SQL} SELECT j, round(v, 4) + 0.0 AS v, i FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY v DESC, i) AS r FROM f) WHERE r = 1")
def sparse_argmax_cols(s, d):
    return _debts(s, d).arg_extreme(True, "j").select("j", (F.round("v", 4) + F.lit(0.0)).alias("v"), "i")


@query("sparse_argmax_all", f"{S_SQL} SELECT i, j, round(v, 4) + 0.0 AS v FROM f ORDER BY f.v DESC, j, i LIMIT 1")
def sparse_argmax_all(s, d):
    return _debts(s, d).arg_extreme(True).select("i", "j", (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query("sparse_full_reductions", f"{S_SQL} SELECT round(max(v), 4) + 0.0 AS max, round(min(v), 4) + 0.0 AS min, round(avg(v), 4) + 0.0 AS mean, count(*) FILTER (v <> 0) AS count, false AS all, true AS any, 0.0::DOUBLE AS prod FROM f")
def sparse_full_reductions(s, d):
    m = _debts(s, d)
    return m.reduce(*[(F.round(m.aggregate(n), 4) + F.lit(0.0)).alias(n) for n in ("max", "min", "mean")], *[m.aggregate(n) for n in ("count", "all", "any", "prod")])


@query("normalized", f"{EW} SELECT i, j, round(v / (SELECT sqrt(sum(v * v)) FROM e), 6) + 0.0 AS v FROM e")
def normalized(s, d):
    return rounded(embeddings(s, d).normalized())


@query("normalize_cols", f"{EW} SELECT i, j, round(v / sqrt(sum(v * v) OVER (PARTITION BY j)), 6) + 0.0 AS v FROM e")
def normalize_cols(s, d):
    return rounded(embeddings(s, d).rowwise_normalized("j"))


@query("equilibrated", "SELECT true AS rows_bounded, true AS cols_bounded, true AS factors_agree")
def equilibrated(s, d):
    """Rows and columns scaled in turn: the largest magnitudes end near 1, and the factors make the matrix."""
    m = _whole(s, d)
    out, left, right = m.scaled(6)
    top = lambda by: out.df.groupBy(by).agg(F.max(F.abs("v")).alias("t")).agg(((F.min("t") > 0.8) & (F.max("t") < 1.25)))
    again = m.df.join(left, "i").join(right, "j").select("i", "j", (F.col("v") * F.col("l") * F.col("r")).alias("w")).join(out.df, ["i", "j"]).agg((F.max(F.abs(F.col("w") - F.col("v"))) < 1e-9).alias("factors_agree"))
    return top("i").toDF("rows_bounded").crossJoin(F.broadcast(top("j").toDF("cols_bounded"))).crossJoin(F.broadcast(again))


@query("closeness_tests", "SELECT true AS smaller, false AS not_smaller, true AS constant, false AS not_constant, true AS zero, true AS identity, true AS skew")
def closeness_tests(s, d):
    m = _whole(s, d)
    parts = {
        "smaller": m.scale(1e-14).is_much_smaller_than(m), "not_smaller": m.is_much_smaller_than(m), "constant": m.map(lambda x: x * 0 + 3).is_constant(3.0), "not_constant": m.is_constant(),
        "zero": m.map(lambda x: x * 0).shape_test("zero"), "identity": Matrix.identity(s, 20).shape_test("identity"), "skew": (m.gram().triangular("strictly_lower") - m.gram().triangular("strictly_lower").transpose()).shape_test("skew_symmetric"),
    }
    out = None
    for name, df in parts.items():
        df = df.toDF(name)
        out = df if out is None else out.crossJoin(F.broadcast(df))
    return out


class Spread:
    """Count, sum and sum of squares: the population variance."""

    def start(self):
        return [0.0, 0.0, 0.0]

    def add(self, state, values):
        return [state[0] + len(values), state[1] + values.sum(), state[2] + (values * values).sum()]

    def zeros(self, state, n):
        return [state[0] + n, *state[1:]]

    def merge(self, a, b):
        return [x + y for x, y in zip(a, b)]

    def result(self, state):
        return state[2] / state[0] - (state[1] / state[0]) ** 2


@query("user_reducer", f"WITH {D_SQL} SELECT i, round(sum(v * v) / 5 / 1e6 - (sum(v) / 5 / 1e3) * (sum(v) / 5 / 1e3), 4) + 0.0 AS v FROM o GROUP BY i")
def user_reducer(s, d):
    """The variance of each row, structural zeros included, as a user's reducer."""
    m = _debts(s, d).scale(1e-3)
    return m.reduce_with(Spread(), "i").select("i", (F.round("v", 4) + F.lit(0.0)).alias("v"))


class Corner:
    """The position-weighted sum and the largest place: what only a visitor sees."""

    def start(self):
        return [0.0, -1.0, -1.0]

    def add(self, state, places, values):
        i, j = places
        return [state[0] + float((values * (j + 1)).sum()), max(state[1], float(i.max())), max(state[2], float(j.max()))]

    def merge(self, a, b):
        return [a[0] + b[0], max(a[1], b[1]), max(a[2], b[2])]


@query("user_visitor", f"{EW} SELECT round(sum(v * (j + 1)), 5) + 0.0 AS weighted, CAST(max(i) AS DOUBLE) AS i, CAST(max(j) AS DOUBLE) AS j FROM e")
def user_visitor(s, d):
    got = embeddings(s, d).visit(Corner())
    return got.select((F.round(F.col("state")[0], 5) + F.lit(0.0)).alias("weighted"), F.col("state")[1].alias("i"), F.col("state")[2].alias("j"))


@query("salted_product", f"WITH {L_SQL} SELECT l.i, CAST(p_size AS BIGINT) AS j, round(sum(l.v * p_retailprice), 6) + 0.0 AS v FROM l JOIN part ON p_partkey = l.j GROUP BY ALL")
def salted_product(s, d):
    """As spmm_order_size, the inner index dealt to eight salts; the product's sum adds up repeated line items, too."""
    y = table(s, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    x = Matrix(table(s, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("long").alias("j"), F.col("p_retailprice").alias("v")), 1 << 40, 64)
    return rounded(Matrix(y, 1 << 40, 1 << 40).product(x, salts=8))


# ---- tensors

A_SQL = """n AS (SELECT CAST(max(vec_id) + 1 AS BIGINT) AS n FROM embeddings),
c AS (SELECT (k - 1) % 4 AS d0, (k - 1) // 4 % 4 AS d1, (k - 1) // 16 AS d2, vec_id AS d3, v FROM (SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"""
R = "round(v, 6) + 0.0 AS v"


def _cubes(s, d):
    m = _whole(s, d)
    return Tensor(m.df.select(F.col("j").alias("d0"), F.col("i").alias("d1"), "v"), (64, m.rows)).reshape((4, 4, 4, m.rows))


def _out(t):
    return t.df.select(*t.names, r6(v()).alias("v"))


@query("tensor_reshape", f"WITH {A_SQL} SELECT d0 + 4 * d1 AS d0, d2 + 4 * d3 AS d1, {R} FROM c")
def tensor_reshape(s, d):
    c = _cubes(s, d)
    return _out(c.reshape((16, 4 * c.dims[3])))


@query("tensor_swap_layout", f"WITH {A_SQL} SELECT d3 AS d0, d2 AS d1, d1 AS d2, d0 AS d3, {R} FROM c")
def tensor_swap_layout(s, d):
    return _out(_cubes(s, d).swap_layout())


@query("tensor_generate", "SELECT a.range AS d0, b.range AS d1, c.range AS d2, a.range + 10.0 * b.range + 100.0 * c.range AS v FROM range(4) a, range(3) b, range(5) c")
def tensor_generate(s, d):
    return _out(Tensor.generate(s, (4, 3, 5), lambda a, b, c: a + 10 * b + 100 * c))


@query("tensor_extremes", f"WITH {A_SQL} SELECT d0, d1, round(max(v), 6) + 0.0 AS high, round(min(v), 6) + 0.0 AS low, bool_and(v <> 0) AS all, bool_or(v > 1) AS any FROM c GROUP BY d0, d1")
def tensor_extremes(s, d):
    c = _cubes(s, d)
    parts = (("high", c.maximum([2, 3])), ("low", c.minimum([2, 3])), ("all", c.all([2, 3])), ("any", c.map(lambda x: (x > 1).cast("double")).any([2, 3])))
    out = None
    for name, t in parts:
        df = t.df.withColumnRenamed("v", name)
        out = df if out is None else out.join(df, ["d0", "d1"])
    return out.select("d0", "d1", r6("high").alias("high"), r6("low").alias("low"), "all", "any")


class Product:
    def start(self):
        return [0.0, 1.0]

    def add(self, state, values):
        return [state[0] + float(np.log1p(np.abs(values)).sum()), state[1] * float(np.prod(np.sign(values)))]

    def merge(self, a, b):
        return [a[0] + b[0], a[1] * b[1]]

    def result(self, state):
        return state[0]


@query("tensor_user_reducer", f"WITH {A_SQL} SELECT d2 AS d0, round(sum(ln(1 + abs(v))), 5) AS v FROM c GROUP BY d2")
def tensor_user_reducer(s, d):
    return _cubes(s, d).reduce_with(Product(), [0, 1, 3]).df.select("d0", F.round("v", 5).alias("v"))


@query("tensor_scan_maximum", f"WITH {A_SQL} SELECT d0, d1, d2, d3, round(max(v) OVER (PARTITION BY d0, d1, d3 ORDER BY d2), 6) + 0.0 AS v FROM c")
def tensor_scan_maximum(s, d):
    return _out(_cubes(s, d).scan(2, F.max))


def _prices(s, d):
    """Order totals along their keys: one long line with gaps."""
    o = table(s, d, "orders")
    n = o.agg(F.max("o_orderkey")).first()[0] + 1
    return Tensor(o.select(F.col("o_orderkey").alias("d0"), F.col("o_totalprice").alias("v")), (n,))


@query("cumsum_long_line", "SELECT o_orderkey AS d0, round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2) + 0.0 AS v FROM orders")
def cumsum_long_line(s, d):
    """Running sums along one line, in blocks of 4,096 places."""
    return _prices(s, d).cumsum(0, stored=True, block=4096).df.select("d0", (F.round("v", 2) + F.lit(0.0)).alias("v"))


@query("cumsum_sparse_line", "WITH n AS (SELECT max(o_orderkey) + 1 AS n FROM orders), g AS (SELECT unnest(range((SELECT min(o_orderkey) FROM orders), (SELECT n FROM n))) AS d0) SELECT d0, round(sum(coalesce(o_totalprice, 0)) OVER (ORDER BY d0), 2) + 0.0 AS v FROM g LEFT JOIN orders ON o_orderkey = d0")
def cumsum_sparse_line(s, d):
    """The same over every place from the first stored one on: missing places are zeros and repeat the sum."""
    return _prices(s, d).cumsum(0, block=4096).df.select("d0", (F.round("v", 2) + F.lit(0.0)).alias("v"))


@query("cumsum_sparse_exclusive", f"WITH {D_SQL}, g AS (SELECT c.i, b.range AS j FROM (SELECT DISTINCT i FROM o) c, range(5) b), f AS (SELECT g.i, g.j, coalesce(v, 0) AS v FROM g LEFT JOIN o USING (i, j)), x AS (SELECT i AS d0, j AS d1, sum(v) OVER (PARTITION BY i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM f) SELECT d0, d1, round(v, 3) + 0.0 AS v FROM x WHERE v > 0")
def cumsum_sparse_exclusive(s, d):
    m = _debts(s, d).scale(-1.0)
    return Tensor.from_matrix(m).cumsum(1, exclusive=True).df.select("d0", "d1", (F.round("v", 3) + F.lit(0.0)).alias("v"))


@query("cumprod_sparse", f"WITH {D_SQL}, f AS (SELECT i, j, v / 100000 AS v, row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS r FROM o) SELECT i AS d0, j AS d1, round(product(v) OVER (PARTITION BY i ORDER BY j), 9) + 0.0 AS v FROM f WHERE r = j")
def cumprod_sparse(s, d):
    """Running products end at the first missing place: there a factor is 0."""
    m = _debts(s, d).scale(-1e-5)
    return Tensor.from_matrix(m).cumprod(1).df.select("d0", "d1", (F.round("v", 9) + F.lit(0.0)).alias("v"))


@query("volume_patches", f"WITH {A_SQL} SELECT a.range AS d0, b.range AS d1, z.range AS d2, CAST(0 AS BIGINT) AS d3, (d0 - a.range) + 3 * (d1 - b.range) + 9 * (d2 - z.range) + 27 * d3 AS d4, {R} FROM c, range(2) a, range(2) b, range(2) z WHERE c.d0 - a.range BETWEEN 0 AND 2 AND c.d1 - b.range BETWEEN 0 AND 2 AND c.d2 - z.range BETWEEN 0 AND 2")
def volume_patches(s, d):
    return _out(_cubes(s, d).volume_patches((2, 2, 2)))


@query("symmetrized", f"WITH {A_SQL} SELECT d0, d1, d2, d3, {R} FROM c WHERE d0 >= d1 UNION ALL SELECT d1, d0, d2, d3, {R} FROM c WHERE d0 > d1")
def symmetrized(s, d):
    c = _cubes(s, d)
    return _out(Tensor(c.df.where("d0 >= d1"), c.dims).symmetrized(0, 1))


@query("custom_operation", f"WITH {A_SQL} SELECT d3 AS d0, round(max(v) - min(v), 6) + 0.0 AS v FROM c GROUP BY d3")
def custom_operation(s, d):
    c = _cubes(s, d)
    return _out(c.custom(lambda df: df.groupBy(F.col("d3").alias("d0")).agg((F.max("v") - F.min("v")).alias("v")), (c.dims[3],)))


@query("contraction_kernel", f"WITH {A_SQL} SELECT a.d0, b.d0 AS d1, round(greatest(sum(a.v * b.v), 0), 6) + 0.0 AS v FROM c a JOIN c b ON a.d1 = b.d1 AND a.d2 = b.d2 AND a.d3 = b.d3 GROUP BY a.d0, b.d0")
def contraction_kernel(s, d):
    """A contraction whose sums go through a rectifier."""
    c = _cubes(s, d)
    return _out(c.contract(c, [(1, 1), (2, 2), (3, 3)], lambda x: F.greatest(x, F.lit(0.0))))


@query("fft_long_line", f"{EW}, x AS (SELECT i, j, v FROM e) SELECT round(sum(v), 4) + 0.0 AS zero, round(sum(v * CASE WHEN (i * 64 + j) % 2 = 0 THEN 1 ELSE -1 END), 4) + 0.0 AS half, round((SELECT count(*) FROM x) * sum(v * v), 2) + 0.0 AS energy FROM x")
def fft_long_line(s, d):
    """All vectors as one line, transformed in four steps: its sum, its alternating sum, and its energy (Parseval)."""
    m = _whole(s, d)
    n = m.rows * 64
    t = Tensor(m.df.select((F.col("i") * 64 + F.col("j")).alias("d0"), "v"), (n,)).fft([0], line=64 * 64)
    at = lambda k: F.sum(F.when(F.col("d0") == k, F.col("re")))
    return t.agg((F.round(at(0), 4) + F.lit(0.0)).alias("zero"), (F.round(at(n // 2), 4) + F.lit(0.0)).alias("half"), (F.round(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 2) + F.lit(0.0)).alias("energy"))


@query("fft_round_trip", f"{EW} SELECT j AS d0, i AS d1, round(v, 6) + 0.0 AS re, 0.0::DOUBLE AS im FROM e")
def fft_round_trip(s, d):
    m = _whole(s, d)
    t = Tensor(m.df.select(F.col("j").alias("d0"), F.col("i").alias("d1"), "v"), (64, m.rows))
    re, im = (t.fft([0], part=p).fft([0], inverse=True) for p in ("real", "imag"))
    im = im.select("d0", "d1", F.col("re").alias("a"), F.col("im").alias("b"))
    return re.join(im, ["d0", "d1"]).select("d0", "d1", r6(F.col("re") - F.col("b")).alias("re"), r6(F.col("im") + F.col("a")).alias("im"))


@query("fft_half_spectrum", f"{EW} SELECT k.range AS d0, i AS d1, round(sum(v * cos(2 * pi() * k.range * j / 64)), 6) + 0.0 AS re, round(sum(-v * sin(2 * pi() * k.range * j / 64)), 6) + 0.0 AS im FROM e, range(33) k GROUP BY k.range, i")
def fft_half_spectrum(s, d):
    m = _whole(s, d)
    t = Tensor(m.df.select(F.col("j").alias("d0"), F.col("i").alias("d1"), "v"), (64, m.rows)).fft([0], half=True)
    return t.select("d0", "d1", r6("re").alias("re"), r6("im").alias("im"))


@query("tensor_text", f"WITH {A_SQL}, l AS (SELECT d2 AS d0, d3 AS d1, d0 AS r, string_agg(printf('%.2f', CASE WHEN round(v, 2) = 0 THEN 0 ELSE round(v, 2) END), ' ' ORDER BY d1) AS line FROM c GROUP BY c.d2, c.d3, c.d0) SELECT d0, d1, '[' || string_agg(line, ';' ORDER BY r) || ']' AS text FROM l GROUP BY d0, d1")
def tensor_text(s, d):
    """Printed 4 x 4 slices."""
    c = _cubes(s, d).map(lambda x: F.when(F.round(x, 2) == 0, 0.0).otherwise(F.round(x, 2)))
    return c.shuffle((2, 3, 0, 1)).formatted(2, " ", ";", "[", "]")


# ---- special functions: identities that SQL states

_f = special.function


@query("gamma_identities", f"WITH {P_SQL} SELECT k, round(1 / x, 8) AS digamma, round(1 / (x * x), 8) AS trigamma, round(1 / (x * x), 8) AS zeta, round(ln(x), 8) + 0.0 AS lgamma FROM p")
def gamma_identities(s, d):
    """Recurrences: digamma, trigamma, zeta(2, x) and lgamma at x + 1 less x."""
    x = F.col("x")
    df = _values(s, d).select("k", *[e.alias(n) for n, e in (("d0", _f("digamma")(x)), ("d1", _f("digamma")(x + 1)), ("t0", _f("polygamma")(F.lit(1.0), x)), ("t1", _f("polygamma")(F.lit(1.0), x + 1)), ("z0", _f("zeta")(F.lit(2.0), x)), ("z1", _f("zeta")(F.lit(2.0), x + 1)), ("l0", _f("lgamma")(x)), ("l1", _f("lgamma")(x + 1)))])
    c = F.col
    return df.select("k", F.round(c("d1") - c("d0"), 8).alias("digamma"), F.round(c("t0") - c("t1"), 8).alias("trigamma"), F.round(c("z0") - c("z1"), 8).alias("zeta"), (F.round(c("l1") - c("l0"), 8) + F.lit(0.0)).alias("lgamma"))


@query("error_functions", f"WITH {P_SQL} SELECT k, 1.0::DOUBLE AS total, 0.0::DOUBLE AS odd, round(x / 4, 8) AS p FROM p")
def error_functions(s, d):
    """erf + erfc = 1, erf is odd, and the normal distribution of its quantile at x / 4 is x / 4."""
    x = F.col("x")
    df = _values(s, d).select("k", "x", _f("erf")(x).alias("a"), _f("erfc")(x).alias("b"), _f("erf")(-x).alias("c"), _f("ndtri")(x / 4).alias("q")).select("k", "a", "b", "c", _f("erfc")(-F.col("q") / math.sqrt(2)).alias("t"))
    return df.select("k", F.round(F.col("a") + F.col("b"), 10).alias("total"), (F.round(F.col("a") + F.col("c"), 10) + F.lit(0.0)).alias("odd"), F.round(F.col("t") / 2, 8).alias("p"))


@query("incomplete_gamma", f"WITH {P_SQL} SELECT k, round(1 - exp(-x), 8) AS one, 1.0::DOUBLE AS total, round(pow(x, x) * exp(-x) / gamma(x + 1), 8) AS step, round(exp(-x), 8) AS der FROM p")
def incomplete_gamma(s, d):
    """igamma(1, x), igamma + igammac, igamma(x, x) - igamma(x + 1, x), and the derivative that makes a unit exponential's sample move."""
    x = F.col("x")
    df = _values(s, d).select("k", "x", _f("igamma")(F.lit(1.0), x).alias("a"), _f("igamma")(x, x + 1).alias("b"), _f("igammac")(x, x + 1).alias("c"), _f("igamma")(x, x).alias("p"), _f("igamma")(x + 1, x).alias("q"), _f("igamma_der_a")(F.lit(1.0), x).alias("r"), _f("gamma_sample_der_alpha")(F.lit(1.0), x).alias("s"))
    c = F.col
    return df.select("k", F.round("a", 8).alias("one"), F.round(c("b") + c("c"), 10).alias("total"), F.round(c("p") - c("q"), 8).alias("step"), F.round(-c("r") / c("s"), 8).alias("der"))


@query("incomplete_gamma_derivative", f"WITH {P_SQL} SELECT k, 0.0::DOUBLE AS gap FROM p")
def incomplete_gamma_derivative(s, d):
    """The derivative in a against a central difference."""
    x, h = F.col("x"), 1e-4
    df = _values(s, d).select("k", _f("igamma_der_a")(x, x + 1).alias("a"), _f("igamma")(x + h, x + 1).alias("p"), _f("igamma")(x - h, x + 1).alias("q"))
    return df.select("k", (F.round(F.col("a") - (F.col("p") - F.col("q")) / (2 * h), 6) + F.lit(0.0)).alias("gap"))


@query("incomplete_beta", f"WITH {P_SQL} SELECT k, round(pow(x / 4, x), 8) AS power, 1.0::DOUBLE AS total FROM p")
def incomplete_beta(s, d):
    """betainc(x, 1, y) = y ** x, and the two tails add up to 1."""
    x = F.col("x")
    df = _values(s, d).select("k", _f("betainc")(x, F.lit(1.0), x / 4).alias("a"), _f("betainc")(x, x + 1, x / 4).alias("b"), _f("betainc")(x + 1, x, 1 - x / 4).alias("c"))
    return df.select("k", F.round("a", 8).alias("power"), F.round(F.col("b") + F.col("c"), 10).alias("total"))


@query("bessel_identities", f"WITH {P_SQL} SELECT k, round(1 / (10 * x), 8) AS ik, round(2 / (pi() * 10 * x), 8) AS jy, 0.0::DOUBLE AS scaled_i, 0.0::DOUBLE AS scaled_k FROM p")
def bessel_identities(s, d):
    """Wronskians I0 K1 + I1 K0 = 1 / x and J1 Y0 - J0 Y1 = 2 / (pi x), and the scaled functions, at ten times the value."""
    x = F.col("x") * 10
    names = ["i0", "i1", "k0", "k1", "j0", "j1", "y0", "y1", "i0e", "i1e", "k0e", "k1e"]
    df = _values(s, d).select("k", x.alias("x"), *[_f(f"bessel_{n}")(x).alias(n) for n in names])
    c = F.col
    return df.select(
        "k", F.round(c("i0") * c("k1") + c("i1") * c("k0"), 8).alias("ik"), F.round(c("j1") * c("y0") - c("j0") * c("y1"), 8).alias("jy"),
        (F.round(c("i0") * F.exp(-c("x")) - c("i0e") + c("i1") * F.exp(-c("x")) - c("i1e"), 10) + F.lit(0.0)).alias("scaled_i"), (F.round(c("k0") / c("k0e") * F.exp(c("x")) - c("k1") / c("k1e") * F.exp(c("x")), 8) + F.lit(0.0)).alias("scaled_k"),
    )


@query("bessel_far_out", f"WITH {P_SQL} SELECT k, round(1000 / (1000 * x), 8) AS ik, round(1000 * 2 / (pi() * 1000 * x), 8) AS jy FROM p")
def bessel_far_out(s, d):
    """The Wronskians at a thousand times the value, by the expansions for large arguments."""
    x = F.col("x") * 1000
    df = _values(s, d).select("k", *[_f(f"bessel_{n}")(x).alias(n) for n in ("i0e", "i1e", "k0e", "k1e", "j0", "j1", "y0", "y1")])
    c = F.col
    return df.select("k", F.round(1000 * (c("i0e") * c("k1e") + c("i1e") * c("k0e")), 8).alias("ik"), F.round(1000 * (c("j1") * c("y0") - c("j0") * c("y1")), 8).alias("jy"))


@query("special_function_limits", "SELECT * FROM (VALUES ('bessel_j0', '1.0', 'nan', '0.0', 'nan'), ('bessel_k0', 'inf', 'nan', '0.0', 'nan'), ('bessel_y0', '-inf', 'nan', '0.0', 'nan'), ('digamma', 'nan', 'nan', 'inf', 'nan'), ('erf', '0.0', '-0.843', '1.0', 'nan'), ('erfc', '1.0', '1.843', '0.0', 'nan'), ('lgamma', 'inf', 'inf', 'inf', 'nan'), ('ndtri', '-inf', 'nan', 'nan', 'nan')) t(name, zero, minus_one, infinite, nan)")
def special_function_limits(s, d):
    """Values at 0, -1, infinity and NaN. (J0 is even: its value at -1 is left out.)"""
    points = s.createDataFrame([(0.0, -1.0, math.inf, math.nan)], "zero double, minus_one double, infinite double, nan double")
    out = None
    for n in ("bessel_j0", "bessel_k0", "bessel_y0", "digamma", "erf", "erfc", "lgamma", "ndtri"):
        shown = []
        for c in points.columns:
            y = _f(n)(F.col(c))
            text = F.round(y, 3).cast("string")
            skip = (n == "bessel_j0" and c == "minus_one") or (n == "digamma" and c == "minus_one")
            shown.append((F.lit("nan") if skip else F.when(F.isnan(y), "nan").when(y == F.lit(E.INF), "inf").when(y == F.lit(-E.INF), "-inf").otherwise(text)).alias(c))
        row = points.select(F.lit(n).alias("name"), *shown)
        out = row if out is None else out.unionByName(row)
    return out


# ---- geometry


def _vectors(s, d):
    """Three-vectors from the start of each embedding."""
    a = F.transform("embedding", lambda x: x.cast("double"))
    return table(s, d, "embeddings").select("vec_id", F.slice(a, 1, 3).alias("a"), F.slice(a, 4, 3).alias("b"))


V_SQL = "w AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a1, CAST(embedding[2] AS DOUBLE) AS a2, CAST(embedding[3] AS DOUBLE) AS a3, CAST(embedding[4] AS DOUBLE) AS b1, CAST(embedding[5] AS DOUBLE) AS b2, CAST(embedding[6] AS DOUBLE) AS b3 FROM embeddings)"


@query("cross_products", f"WITH {V_SQL} SELECT vec_id, round(a2 * b3 - a3 * b2, 6) + 0.0 AS x, round(a3 * b1 - a1 * b3, 6) + 0.0 AS y, round(a1 * b2 - a2 * b1, 6) + 0.0 AS z, 0.0::DOUBLE AS orthogonal, 1.0::DOUBLE AS unit FROM w")
def cross_products(s, d):
    """Cross products, and a unit vector orthogonal to the first."""
    df = _vectors(s, d).withColumn("c", G.cross(F.col("a"), F.col("b"))).withColumn("u", G.unit_orthogonal(F.col("a")))
    return df.select("vec_id", *[r6(F.col("c")[k]).alias(n) for k, n in enumerate("xyz")], r6(E.dot(F.col("u"), F.col("a"))).alias("orthogonal"), r6(E.array_norm(F.col("u"))).alias("unit"))


@query("box_functions", f"WITH {V_SQL}, b AS (SELECT *, least(a1, b1) AS l1, least(a2, b2) AS l2, least(a3, b3) AS l3, greatest(a1, b1) AS h1, greatest(a2, b2) AS h2, greatest(a3, b3) AS h3 FROM w) SELECT vec_id, (l1 <= 0 AND 0 <= h1 AND l2 <= 0 AND 0 <= h2 AND l3 <= 0 AND 0 <= h3) AS inside, (l1 <= 0.5 AND -0.5 <= h1 AND l2 <= 0.5 AND -0.5 <= h2 AND l3 <= 0.5 AND -0.5 <= h3) AS meets, round((h1 - l1) * (h2 - l2) * (h3 - l3), 6) + 0.0 AS volume, round((l1 + h1) / 2, 6) + 0.0 AS centre, round(sqrt(pow(greatest(l1, -h1, 0), 2) + pow(greatest(l2, -h2, 0), 2) + pow(greatest(l3, -h3, 0), 2)), 6) + 0.0 AS distance FROM b")
def box_functions(s, d):
    """The box of two points: whether it holds the origin, meets a cube about it, its volume, centre and distance from it."""
    low, high = F.zip_with("a", "b", lambda x, y: F.least(x, y)), F.zip_with("a", "b", lambda x, y: F.greatest(x, y))
    df = _vectors(s, d).select("vec_id", low.alias("low"), high.alias("high"))
    origin, half = F.array(*[F.lit(0.0)] * 3), F.array(*[F.lit(0.5)] * 3)
    lo, hi = F.col("low"), F.col("high")
    return df.select("vec_id", G.box_contains(lo, hi, origin).alias("inside"), G.box_intersects(lo, hi, F.transform(half, lambda x: -x), half).alias("meets"), r6(G.box_volume(lo, hi)).alias("volume"), r6(G.box_center(lo, hi)[0]).alias("centre"), r6(G.box_exterior_distance(lo, hi, origin)).alias("distance"))


@query("lines_and_planes", f"WITH {V_SQL} SELECT vec_id, 0.0::DOUBLE AS on_plane, round(sqrt(a2 * a2 + a3 * a3), 6) AS from_axis, round(a1, 6) + 0.0 AS along, round(2.0, 6) AS meets_at FROM w")
def lines_and_planes(s, d):
    """A point's projection on a plane lies on it; its distance from the x axis; its projection there; where the axis meets x = 2."""
    normal = F.array(*[F.lit(x / 3) for x in (1.0, 2.0, 2.0)])
    origin, axis = F.array(*[F.lit(0.0)] * 3), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    p = F.col("a")
    df = _vectors(s, d).select("vec_id", "a", G.plane_projection(normal, F.lit(0.5), p).alias("q"))
    return df.select("vec_id", r6(G.plane_signed_distance(normal, F.lit(0.5), F.col("q"))).alias("on_plane"), r6(G.line_distance(origin, axis, p)).alias("from_axis"), r6(G.line_projection(origin, axis, p)[0]).alias("along"), r6(G.line_plane_intersection(origin, axis, axis, F.lit(-2.0))[0]).alias("meets_at"))


@query("transforms", f"WITH {V_SQL} SELECT vec_id, round(2 * a2 + 1, 6) + 0.0 AS x, round(-2 * a1 + 2, 6) + 0.0 AS y, round(2 * a3 + 3, 6) + 0.0 AS z, round(a1, 6) + 0.0 AS back FROM w")
def transforms(s, d):
    """A turn, a scaling and a shift as one homogeneous matrix; homogeneous and back."""
    linear = F.array(*[F.lit(float(x)) for x in (0, 2, 0, -2, 0, 0, 0, 0, 2)])
    m = G.affine(linear, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), 3)
    df = _vectors(s, d).select("vec_id", "a", m.alias("m")).select("vec_id", "a", G.transform_point(F.col("m"), F.col("a"), 3).alias("p"))
    return df.select("vec_id", *[r6(F.col("p")[k]).alias(n) for k, n in enumerate("xyz")], r6(G.hnormalized(G.homogeneous(F.col("a")))[0]).alias("back"))


@query("inverse_3x3", "SELECT vec_id, 1.0::DOUBLE AS diagonal, 0.0::DOUBLE AS rest FROM embeddings")
def inverse_3x3(s, d):
    """The product of 3 x 3 matrices and their inverses."""
    m = F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 9)
    df = table(s, d, "embeddings").select("vec_id", m.alias("m")).withColumn("w", G.inverse3(F.col("m"))).withColumn("p", G.mat_mul(F.col("m"), F.col("w"), 3))
    p = F.col("p")
    return df.select("vec_id", F.round((p[0] + p[4] + p[8]) / 3, 5).alias("diagonal"), (F.round(sum((p[k] for k in (1, 2, 3, 5, 6)), p[7]), 5) + F.lit(0.0)).alias("rest"))


@query("quaternion_algebra", f"WITH {P_SQL} SELECT k, 1.0::DOUBLE AS identity, round(x / 2, 6) AS distance, round(cos(x / 4), 6) AS halfway, round(x, 6) AS angle FROM p")
def quaternion_algebra(s, d):
    """q times its inverse; the angle between turns by x and x / 2; halfway to x / 2 on the shortest way; the turn's angle back."""
    axis = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    unit = G.quaternion(1.0, 0.0, 0.0, 0.0)
    df = _values(s, d).select("k", G.q_from_axis_angle(axis, F.col("x")).alias("q"), G.q_from_axis_angle(axis, F.col("x") / 2).alias("h"), unit.alias("u"))
    q, h = F.col("q"), F.col("h")
    df = df.select("k", G.q_mul(q, G.q_inverse(q)).alias("i"), G.q_angular_distance(q, h).alias("a"), G.q_slerp(F.col("u"), q, F.lit(0.5)).alias("s"), G.q_to_scaled_axis(q).alias("r"))
    return df.select("k", r6(F.col("i.w")).alias("identity"), r6("a").alias("distance"), r6(F.col("s.w")).alias("halfway"), r6(F.col("r")[2]).alias("angle"))


@query("skew_symmetric", f"WITH {V_SQL} SELECT vec_id, round(a2 * b3 - a3 * b2, 6) + 0.0 AS x, round(a3 * b1 - a1 * b3, 6) + 0.0 AS y, 0.0::DOUBLE AS trace FROM w")
def skew_symmetric(s, d):
    """The matrix of a cross product applied to a vector."""
    df = _vectors(s, d).withColumn("m", G.skew_symmetric(F.col("a"))).withColumn("p", G.mat_vec(F.col("m"), F.col("b"), 3))
    m = F.col("m")
    return df.select("vec_id", r6(F.col("p")[0]).alias("x"), r6(F.col("p")[1]).alias("y"), r6(m[0] + m[4] + m[8]).alias("trace"))


@query("closest_pair", "WITH c AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer), s AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier) SELECT a, b, round(g, 6) AS distance FROM (SELECT c.id AS a, s.id AS b, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS g FROM c, s ORDER BY g, a, b LIMIT 1)")
def closest_pair(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    t = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return spatial.closest_pair(c, t, ["x", "y"], 4.0).select("a", "b", r6("distance").alias("distance"))


@query("balls_about_a_point", "SELECT c_custkey AS id FROM customer WHERE pow(c_acctbal / 100 - 10, 2) + pow(c_nationkey - 12, 2) <= 100")
def balls_about_a_point(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return spatial.within(c, ["x", "y"], [10.0, 12.0], 10.0).select("id")


@query("overlap_of_wide_balls", "WITH c AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y, CASE WHEN c_custkey % 50 = 0 THEN 20.0 ELSE 0.2 END AS r FROM customer), s AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, CAST(s_nationkey AS DOUBLE) AS y, 0.5 AS r FROM supplier) SELECT c.id AS a, s.id AS b FROM c JOIN s ON (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) <= (c.r + s.r) * (c.r + s.r)")
def overlap_of_wide_balls(s, d):
    """Balls of very different widths: wide ones go to coarse cells."""
    r = F.when(F.col("c_custkey") % 50 == 0, Decimal("20.0")).otherwise(Decimal("0.2"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"), r.alias("r"))
    t = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.lit(Decimal("0.5")).alias("r"))
    return spatial.overlapping_pairs(c, t, ["x", "y"], 0.5)


# ---- block-sparse


def _blocks(s, d):
    """Customers x priorities in blocks of four."""
    return BlockMatrix.of(_debts(s, d).scale(-1e-3), 4)


B_SQL = f"WITH {D_SQL}, b AS (SELECT i, j, v / 1000 AS v FROM o)"


@query("block_sparse_product", f"{B_SQL} SELECT x.j AS i, y.j AS j, round(sum(x.v * y.v), 2) + 0.0 AS v FROM b x JOIN b y USING (i) GROUP BY x.j, y.j")
def block_sparse_product(s, d):
    b = _blocks(s, d)
    return (b.transpose() @ b).matrix().df.select("i", "j", (F.round("v", 2) + F.lit(0.0)).alias("v"))


@query("block_sparse_times_dense", f"{B_SQL} SELECT i, k.range AS j, round(sum(v * (1 + j + k.range)), 6) + 0.0 AS v FROM b, range(3) k GROUP BY i, k.range")
def block_sparse_times_dense(s, d):
    x = Matrix.generate(s, 5, 3, lambda i, j: 1.0 + i + j)
    return rounded(_blocks(s, d).times(x))


@query("block_sparse_arithmetic", f"{B_SQL} SELECT i, j, round(v * v + v / 2, 4) + 0.0 AS v FROM b")
def block_sparse_arithmetic(s, d):
    b = _blocks(s, d)
    return (b.conjunction(b) + b.map(lambda x: x / 2)).matrix().df.select("i", "j", (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query("block_sparse_views", f"WITH {L_SQL} SELECT i, j, round(v, 6) + 0.0 AS v FROM l WHERE i >= j UNION ALL SELECT j, i, round(v, 6) + 0.0 FROM l WHERE i > j")
def block_sparse_views(s, d):
    """The lower triangle and its mirror."""
    return rounded(BlockMatrix.of(lineitems(s, d), 4).selfadjoint("lower").matrix())


@query("block_sparse_diagonal", f"WITH {L_SQL} SELECT i, CAST(0 AS BIGINT) AS j, round(v, 6) + 0.0 AS v FROM l WHERE i = j")
def block_sparse_diagonal(s, d):
    return rounded(BlockMatrix.of(lineitems(s, d), 4).diagonal())


@query("block_sparse_triangular_solve", "SELECT range AS i, CAST(0 AS BIGINT) AS j, 1.0 + range % 5 AS v FROM range(64)")
def block_sparse_triangular_solve(s, d):
    """L x = b in blocks of eight, L the lower half of the Gram matrix."""
    b = BlockMatrix.of(embeddings(s, d).gram(), 8).triangular("lower")
    x = Matrix.generate(s, 64, 1, lambda i, j: 1.0 + i % 5)
    return b.triangular_solve(b.times(x)).df.select("i", "j", (F.round("v", 5) + F.lit(0.0)).alias("v"))


# ---- files


@query("market_round_trip", f"WITH {L_SQL} SELECT i, j, round(v, 6) + 0.0 AS v FROM l")
def market_round_trip(s, d):
    from veldt.sources import market

    m = lineitems(s, d)
    rows, cols = m.df.agg(F.max("i"), F.max("j")).first()
    path = scratch(s, "lines.mtx")
    market.save_sparse(Matrix(m.df, rows + 1, cols + 1), path)
    return rounded(market.load_sparse(s, path))


@query("market_dense_round_trip", f"{EW} SELECT i, j, round(v, 6) + 0.0 AS v FROM e")
def market_dense_round_trip(s, d):
    from veldt.sources import market

    path = scratch(s, "vectors.mtx")
    market.save_dense(_whole(s, d), path)
    return rounded(market.load_dense(s, path))


@query("binary_round_trip", f"WITH {O_SQL} SELECT i, j, round(v, 6) + 0.0 AS v FROM o")
def binary_round_trip(s, d):
    from veldt.sources import market

    m = orders(s, d)
    path = scratch(s, "orders.bin")
    market.save_binary(m, path)
    return rounded(market.load_binary(s, path, m.rows, m.cols))


@query("printed_rows", f"{EW} SELECT i, '[' || string_agg(printf('%8.2f', CASE WHEN round(v, 2) = 0 THEN 0 ELSE round(v, 2) END), ',' ORDER BY j) || ']' AS line FROM e GROUP BY i")
def printed_rows(s, d):
    from veldt.sources import market

    m = _whole(s, d).map(lambda x: F.when(F.round(x, 2) == 0, 0.0).otherwise(F.round(x, 2)))
    return market.format_rows(m, 2, ",", "[", "]", 8)


# ---- products of views, updates and single writes

G_SQL = f"{E_SQL}, g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM e a JOIN e b USING (i) GROUP BY a.j, b.j)"
X64 = "x AS (SELECT range AS j, 1.0 + range % 5 AS x FROM range(64))"


def _steps(s):
    return Matrix.generate(s, 64, 1, lambda i, j: 1.0 + i % 5)


def _solution(m):
    return m.df.select("i", "j", (F.round("v", 5) + F.lit(0.0)).alias("v"))


@query("triangular_products", f"WITH {G_SQL}, {X64} SELECT g.i, CAST(0 AS BIGINT) AS j, round(sum(g.v * x) FILTER (g.i >= g.j), 5) + 0.0 AS v FROM g JOIN x USING (j) GROUP BY g.i UNION ALL SELECT g.i, CAST(1 AS BIGINT), round(sum(g.v * x) FILTER (g.i < g.j), 5) + 0.0 FROM g JOIN x USING (j) GROUP BY g.i HAVING count(*) FILTER (g.i < g.j) > 0")
def triangular_products(s, d):
    """The products with the lower triangle and with the strict upper one."""
    g, x = embeddings(s, d).gram(), _steps(s)
    lower, upper = blas.trmv(g, x, "lower"), g.triangular("strictly_upper") @ x
    return _solution(lower.hcat(upper))


@query("selfadjoint_product", f"WITH {G_SQL}, {X64} SELECT g.i, CAST(0 AS BIGINT) AS j, round(2 * sum(g.v * x), 5) + 0.0 AS v FROM g JOIN x USING (j) GROUP BY g.i")
def selfadjoint_product(s, d):
    """2 A x, only A's lower half read."""
    return _solution(blas.symv(2.0, embeddings(s, d).gram().triangular("lower"), _steps(s)))


@query("general_products", f"WITH {G_SQL}, {X64}, p AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM g a JOIN g b ON a.j = b.i GROUP BY a.i, b.j) SELECT p.i, p.j, round((0.5 * p.v + 2 * g.v) / 1000, 5) + 0.0 AS v FROM p JOIN g ON p.i = g.i AND p.j = g.j")
def general_products(s, d):
    """alpha A B + beta C."""
    g = embeddings(s, d).gram()
    return _solution(blas.gemm(0.5, g, g, 2.0, g).scale(1e-3))


@query("rank_two_update", f"WITH {G_SQL} SELECT i, j, round(v + 0.5 * ((1 + i % 5) * (j + 1) + (i + 1) * (1 + j % 5)), 5) + 0.0 AS v FROM g")
def rank_two_update(s, d):
    return _solution(blas.syr2(0.5, _steps(s), Matrix.linspaced(s, 64, 1.0, 64.0), embeddings(s, d).gram()))


@query("symmetric_rank_k", f"WITH {G_SQL} SELECT i, j, round(3 * v + CASE WHEN i = j THEN 2 ELSE 0 END, 5) + 0.0 AS v FROM g")
def symmetric_rank_k(s, d):
    return _solution(blas.syrk(3.0, _whole(s, d), 2.0, Matrix.identity(s, 64), trans=True))


@query("triangular_systems", "SELECT range AS i, CAST(0 AS BIGINT) AS j, 1.0 + range % 5 AS v FROM range(64) UNION ALL SELECT range, CAST(1 AS BIGINT), 1.0 + range % 5 FROM range(64)")
def triangular_systems(s, d):
    """L x = b and L^T x = b."""
    low, x = (embeddings(s, d).gram() + Matrix.identity(s, 64)).triangular("lower"), _steps(s)
    return _solution(blas.trsv(low, blas.trmv(low, x)).hcat(blas.trsv(low, blas.trmv(low, x, trans=True), trans=True)))


@query("vector_operations", "SELECT round(sum(2 * c_acctbal + c_custkey), 2) AS axpy, round(sqrt(sum(c_acctbal * c_acctbal)), 4) AS nrm2, round(sum(abs(c_acctbal)), 2) AS asum, round(sum(c_acctbal * c_custkey), 2) AS dot, round(sum(0.6 * c_acctbal + 0.8 * c_custkey), 2) AS rot, (SELECT c_custkey FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 1) AS iamax FROM customer")
def vector_operations(s, d):
    zero = F.lit(0).cast("long").alias("j")
    c = table(s, d, "customer")
    x, y = (Matrix(c.select(F.col("c_custkey").alias("i"), zero, F.col(n).cast("double").alias("v")), 1 << 40, 1) for n in ("c_acctbal", "c_custkey"))
    total = lambda m, n: m.df.agg(F.round(F.sum("v"), 2).alias(n))
    parts = [total(blas.axpy(2.0, x, y), "axpy"), blas.nrm2(x).select(F.round("norm", 4).alias("nrm2")), blas.asum(x).select(F.round("asum", 2).alias("asum")), blas.dot(x, y).select(F.round("dot", 2).alias("dot")), total(blas.rot(x, y, 0.6, 0.8)[0], "rot"), blas.iamax(x).select(F.col("i").alias("iamax"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


@query("plane_rotation", f"{EW} SELECT i, j, round(v, 6) + 0.0 AS v FROM e WHERE j NOT IN (3, 7) UNION ALL SELECT a.i, CAST(3 AS BIGINT), round(0.6 * a.v + 0.8 * b.v, 6) + 0.0 FROM e a JOIN e b ON a.i = b.i AND a.j = 3 AND b.j = 7 UNION ALL SELECT a.i, CAST(7 AS BIGINT), round(0.6 * b.v - 0.8 * a.v, 6) + 0.0 FROM e a JOIN e b ON a.i = b.i AND a.j = 3 AND b.j = 7")
def plane_rotation(s, d):
    return rounded(embeddings(s, d).rotated(3, 7, 0.6, 0.8, "right"))


@query("swapped_rows_and_cols", f"{NW} SELECT CASE i WHEN 0 THEN n - 1 WHEN n - 1 THEN 0 ELSE i END AS i, CASE j WHEN 5 THEN 60 WHEN 60 THEN 5 ELSE j END AS j, round(v, 6) + 0.0 AS v FROM e, n")
def swapped_rows_and_cols(s, d):
    m = _whole(s, d)
    return rounded(m.swap_rows(0, m.rows - 1).swap_cols(5, 60))


@query("permutation_algebra", f"{NW} SELECT i, j, round(v, 6) + 0.0 AS v FROM e UNION ALL SELECT i + n, j, round(v, 6) + 0.0 FROM e, n")
def permutation_algebra(s, d):
    """A permutation and then its inverse; and their product, which is the identity."""
    m = _whole(s, d)
    p = table(s, d, "embeddings").select(F.col("vec_id").alias("i"), ((F.col("vec_id") + 7) % m.rows).alias("p"))
    back = m.permuted(left=p).permuted(left=permutation_inverse(p))
    return rounded(back.vcat(m.permuted(left=permutation_product(permutation_inverse(p), p))))


@query("transposition_sequence", f"{EW} SELECT i, (j + 1) % 64 AS j, round(v, 6) + 0.0 AS v FROM e")
def transposition_sequence(s, d):
    """Exchanging each column with the last, one after another, turns all by one place."""
    return rounded(embeddings(s, d).permuted(right=transpositions(s, [63] * 64)))


@query("single_writes", "SELECT user_id AS i, CAST(0 AS BIGINT) AS j, arg_max(value, event_id) AS v FROM events GROUP BY user_id")
def single_writes(s, d):
    df = table(s, d, "events").select(F.col("user_id").alias("i"), F.lit(0).cast("long").alias("j"), F.col("value").alias("v"), "event_id")
    return Matrix.from_writes(df, 1 << 40, 1, F.col("event_id")).df


@query("set_from_sorted", f"WITH {O_SQL} SELECT i, j, round(v, 6) + 0.0 AS v FROM o UNION ALL SELECT c_custkey, CAST(5 AS BIGINT), round(c_acctbal, 6) + 0.0 FROM customer")
def set_from_sorted(s, d):
    """An empty batch keeps what is stored; another replaces it."""
    o = orders(s, d)
    batch = table(s, d, "customer").select(F.col("c_custkey").alias("i"), F.lit(0).cast("long").alias("j"), F.col("c_acctbal").alias("v"))
    return rounded(o.set_from_sorted(batch.where("false")).hcat(o.set_from_sorted(batch)))


@query("lower_bounds", f"WITH {O_SQL} SELECT i, round(v, 6) + 0.0 AS v FROM o WHERE j = 2 AND i >= 50 ORDER BY o.i LIMIT 1")
def lower_bounds(s, d):
    return orders(s, d).lower_bound(2, 50).select("i", r6("v").alias("v"))


# ---- more geometry


@query("euler_sequences", f"WITH {P_SQL} SELECT k, 0.0::DOUBLE AS worst FROM p")
def euler_sequences(s, d):
    """For all twelve sequences of axes: the angles back from the rotation they make."""
    x = F.col("x")
    want = [x / 3, x / 4, x / 5]
    worst = []
    for a0, a1, a2 in [(p, q, r) for p in range(3) for q in range(3) for r in range(3) if p != q and q != r]:
        turns = F.array(*[G.axis_rotation(a, w) for a, w in zip((a0, a1, a2), want)])
        m = E.let(turns, lambda t: E.let(G.mat_mul(t[0], t[1], 3), lambda p: G.mat_mul(p, t[2], 3)))
        worst.append(E.let(G.euler_sequence(m, a0, a1, a2), lambda t: F.greatest(*[F.abs(t[k] - w) for k, w in enumerate(want)])))
    return _values(s, d).select("k", (F.round(F.greatest(*worst), 6) + F.lit(0.0)).alias("worst"))


@query("angle_axis_back", f"WITH {P_SQL} SELECT k, round(x, 6) AS angle, round(2.0 / 3, 6) AS axis, round(x / 2, 6) AS halfway FROM p")
def angle_axis_back(s, d):
    """A turn's angle and axis from its matrix; halfway between two turns of the plane."""
    axis = F.array(*[F.lit(t / 3) for t in (1.0, 2.0, 2.0)])
    df = _values(s, d).select("k", "x", G.q_from_axis_angle(axis, F.col("x")).alias("q")).select("k", "x", G.q_matrix(F.col("q")).alias("m"), G.rotation2(F.col("x")).alias("r"))
    a = G.angle_axis(F.col("m"))
    return df.select("k", a.alias("a"), G.rotation2_slerp(F.lit(0.0), G.rotation2_angle(F.col("r")), F.lit(0.5)).alias("h")).select("k", r6(F.col("a.angle")).alias("angle"), r6(F.col("a.axis")[1]).alias("axis"), r6("h").alias("halfway"))


@query("transform_inverses", f"WITH {V_SQL} SELECT vec_id, 0.0::DOUBLE AS isometry, 0.0::DOUBLE AS affine, round(3 * a1 + 1, 6) + 0.0 AS composed FROM w")
def transform_inverses(s, d):
    """Points through a map and its inverse; a scaling and then a shift."""
    p, one = F.col("a"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    turn = G.affine(G.axis_rotation(2, F.lit(0.7)), one, 3)
    skew = G.affine(F.array(*[F.lit(float(x)) for x in (2, 1, 0, 0, 3, 1, 1, 0, 4)]), one, 3)
    stretch = G.transform_product(G.translation(one, 3), G.scaling(F.array(F.lit(3.0), F.lit(1.0), F.lit(1.0)), 3), 3)
    df = _vectors(s, d).select("vec_id", "a", turn.alias("t"), skew.alias("s"), stretch.alias("c"))
    df = df.select("vec_id", "a", "t", "s", "c", G.isometry_inverse(F.col("t"), 3).alias("ti"), G.affine_inverse3(F.col("s")).alias("si"))
    df = df.select("vec_id", "a", "ti", "si", "c", G.transform_point(F.col("t"), p, 3).alias("tp"), G.transform_point(F.col("s"), p, 3).alias("sp"))
    df = df.select("vec_id", "a", G.transform_point(F.col("ti"), F.col("tp"), 3).alias("x"), G.transform_point(F.col("si"), F.col("sp"), 3).alias("y"), G.transform_point(F.col("c"), p, 3).alias("z"))
    gap = lambda c: (F.round(E.array_norm(F.zip_with(c, "a", lambda u, w: u - w)), 6) + F.lit(0.0))
    return df.select("vec_id", gap("x").alias("isometry"), gap("y").alias("affine"), r6(F.col("z")[0]).alias("composed"))


@query("box_shapes", f"WITH {V_SQL} SELECT vec_id, round(sqrt(pow(a1 - b1, 2) + pow(a2 - b2, 2) + pow(a3 - b3, 2)), 6) AS diagonal, round(greatest(a1, b1, 0) - least(a1, b1, 0), 6) AS extended, round(least(greatest(least(a1, b1), 0), greatest(a1, b1)), 6) + 0.0 AS clamped, round(greatest(a2, b2), 6) + 0.0 AS corner, false AS empty, 0.0::DOUBLE AS plane FROM w")
def box_shapes(s, d):
    df = _vectors(s, d).select("vec_id", "a", "b", F.zip_with("a", "b", lambda x, y: F.least(x, y)).alias("low"), F.zip_with("a", "b", lambda x, y: F.greatest(x, y)).alias("high"))
    lo, hi, origin = F.col("low"), F.col("high"), F.array(*[F.lit(0.0)] * 3)
    low2, high2 = G.box_extended(lo, hi, origin)
    plane = G.plane_through(F.col("a"), F.col("b"), F.array(F.lit(9.0), F.lit(0.0), F.lit(1.0)))
    df = df.select("*", low2.alias("l2"), high2.alias("h2"), plane.alias("p"))
    on = G.plane_signed_distance(F.col("p.normal"), F.col("p.offset"), F.col("b"))
    return df.select("vec_id", r6(G.box_diagonal(lo, hi)).alias("diagonal"), F.round(G.box_sizes(F.col("l2"), F.col("h2"))[0], 6).alias("extended"), r6(G.box_clamped(lo, hi, origin)[0]).alias("clamped"), r6(G.box_corner(lo, hi, 2, 3)[1]).alias("corner"), G.box_is_empty(lo, hi).alias("empty"), r6(on).alias("plane"))


@query("strided_volume_patches", f"WITH {A_SQL} SELECT o0.range AS d0, o1.range AS d1, o2.range AS d2, CAST(0 AS BIGINT) AS d3, x.range + 2 * y.range + 4 * z.range + 8 * d3 AS d4, {R} FROM c, range(3) o0, range(3) o1, range(3) o2, range(2) x, range(2) y, range(2) z WHERE c.d0 = x.range * 2 + o0.range AND c.d1 = y.range * 2 + o1.range AND c.d2 = z.range * 2 + o2.range")
def strided_volume_patches(s, d):
    """3 x 3 x 3 patches at every second place, over the far edges: "same" padding of 4 places by 2 puts nothing before."""
    return _out(_cubes(s, d).volume_patches((3, 3, 3), (2, 2, 2), "same"))


@query("symmetry_group", f"WITH {A_SQL}, h AS (SELECT * FROM c WHERE d0 > d1 AND d1 > d2) SELECT d0, d1, d2, d3, {R} FROM h UNION ALL SELECT d1, d0, d2, d3, round(-v, 6) + 0.0 FROM h UNION ALL SELECT d0, d2, d1, d3, round(-v, 6) + 0.0 FROM h UNION ALL SELECT d2, d1, d0, d3, round(-v, 6) + 0.0 FROM h UNION ALL SELECT d1, d2, d0, d3, {R} FROM h UNION ALL SELECT d2, d0, d1, d3, {R} FROM h")
def symmetry_group(s, d):
    """Entries with descending indices, made antisymmetric in three dimensions."""
    c = _cubes(s, d)
    return _out(Tensor(c.df.where("d0 > d1 and d1 > d2"), c.dims).symmetrized_by([((1, 0, 2, 3), -1), ((0, 2, 1, 3), -1)]))


@query("ranked_columns", f"{EW} SELECT i, j, round(v, 6) + 0.0 AS v, row_number() OVER (PARTITION BY j ORDER BY e.v, i) - 1 AS place FROM e")
def ranked_columns(s, d):
    return embeddings(s, d).sorted_with_permutation("j").select("i", "j", r6("v").alias("v"), "place")


@query("strided_buffer", "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(v AS DOUBLE) AS v FROM (VALUES (0, 0, 0), (1, 0, 2), (0, 1, 5), (1, 1, 7), (0, 2, 10), (1, 2, 12)) t(i, j, v)")
def strided_buffer(s, d):
    return rounded(Matrix.from_buffer(s, list(range(15)), 2, 3, 2, 5))


@query("orthogonality", "SELECT true AS axes, false AS rows, true AS unitary")
def orthogonality(s, d):
    m = _whole(s, d)
    same, other = Matrix.unit(s, 9, 2).is_orthogonal(Matrix.unit(s, 9, 4)), m.row(0).is_orthogonal(m.row(1))
    return same.toDF("axes").crossJoin(F.broadcast(other.toDF("rows"))).crossJoin(F.broadcast(Matrix.identity(s, 30).swap_rows(3, 8).is_unitary().toDF("unitary")))


@query("tensor_random", "SELECT CAST(24000 AS BIGINT) AS n, true AS inside, true AS normal")
def tensor_random(s, d):
    u, g = Tensor.random(s, (20, 30, 40), 5), Tensor.random(s, (20, 30, 40), 6, normal=True)
    one = u.df.agg(F.count("v").alias("n"), ((F.min("v") >= 0) & (F.max("v") < 1) & (F.abs(F.avg("v") - 0.5) < 0.02)).alias("inside"))
    return one.crossJoin(F.broadcast(g.df.agg(((F.abs(F.avg("v")) < 0.05) & (F.abs(F.avg(v() * v()) - 1) < 0.05)).alias("normal"))))
