"""Queries of matrix construction, indexing, reductions, sparse algebra and products."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veldt.functions import elementwise as E
from veldt.operators import dense
from veldt.operators.matrix import Matrix
from veldt.plans._register import E_SQL, L_SQL, O_SQL, ORACLES, embeddings, lineitems, orders, query, r6, rounded, table

def v():
    return F.col("v")
ROUND = "SELECT i, j, round(v, 6) + 0.0 AS v FROM"
EW = f"WITH {E_SQL}"


@query("gram_embeddings", f"{EW} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM e a JOIN e b USING (i) GROUP BY a.j, b.j")
def gram_embeddings(s, d):
    return rounded(Matrix(dense.gram_frame(table(s, d, "embeddings"), "embedding", 64), 64, 64))


@query("gram_relational", ORACLES["gram_embeddings"])
def gram_relational(s, d):
    """The same by a join of the triplets with themselves."""
    return rounded(embeddings(s, d).gram())


@query("triplets_sum", f"WITH {L_SQL} {ROUND} l")
def triplets_sum(s, d):
    return rounded(lineitems(s, d))


@query("triplets_last", "SELECT user_id AS i, CAST(length(event_type) AS BIGINT) AS j, arg_max(value, event_id) AS v FROM events GROUP BY ALL")
def triplets_last(s, d):
    df = table(s, d, "events").select(F.col("user_id").alias("i"), F.length("event_type").cast("long").alias("j"), F.col("value").alias("v"), "event_id")
    return Matrix.from_triplets(df, 1 << 40, 64, "last", F.col("event_id")).df


@query("insert_triplets_merge", f"WITH {O_SQL}, b AS (SELECT c_custkey AS i, CAST(0 AS BIGINT) AS j, c_acctbal AS v FROM customer) SELECT i, j, round(sum(v), 6) + 0.0 AS v FROM (SELECT * FROM o UNION ALL SELECT * FROM b) GROUP BY ALL")
def insert_triplets_merge(s, d):
    batch = table(s, d, "customer").select(F.col("c_custkey").alias("i"), F.lit(0).cast("long").alias("j"), F.col("c_acctbal").alias("v"))
    return rounded(orders(s, d).insert_triplets(batch))


@query("sparse_product", f"WITH {L_SQL}, {O_SQL}, x AS (SELECT o_orderkey AS i, o_custkey AS j, 1.0 AS v FROM orders) SELECT x.j AS i, l.j AS j, round(sum(x.v * l.v), 6) + 0.0 AS v FROM x JOIN l ON x.i = l.i GROUP BY x.j, l.j")
def sparse_product(s, d):
    x = Matrix(table(s, d, "orders").select(F.col("o_custkey").alias("i"), F.col("o_orderkey").alias("j"), F.lit(1.0).alias("v")), 1 << 40, 1 << 40)
    return rounded(x @ lineitems(s, d))


@query("sparse_product_pruned", f"WITH {L_SQL}, x AS (SELECT o_orderkey AS i, o_custkey AS j FROM orders), y AS (SELECT x.j AS i, l.j AS j, sum(l.v) AS v FROM x JOIN l ON x.i = l.i GROUP BY x.j, l.j) {ROUND} y WHERE abs(v) > 40")
def sparse_product_pruned(s, d):
    x = Matrix(table(s, d, "orders").select(F.col("o_custkey").alias("i"), F.col("o_orderkey").alias("j"), F.lit(1.0).alias("v")), 1 << 40, 1 << 40)
    return rounded(x.product_pruned(lineitems(s, d), 40.0))


@query("spmv", f"WITH {L_SQL} SELECT l.i, CAST(0 AS BIGINT) AS j, round(sum(l.v * p_retailprice), 6) + 0.0 AS v FROM l JOIN part ON p_partkey = l.j GROUP BY l.i")
def spmv(s, d):
    x = Matrix(table(s, d, "part").select(F.col("p_partkey").alias("i"), F.lit(0).cast("long").alias("j"), F.col("p_retailprice").alias("v")), 1 << 40, 1)
    return rounded(lineitems(s, d) @ x)


@query("spmm_order_size", f"WITH {L_SQL} SELECT l.i, CAST(p_size AS BIGINT) AS j, round(sum(l.v * p_retailprice), 6) + 0.0 AS v FROM l JOIN part ON p_partkey = l.j GROUP BY ALL")
def spmm_order_size(s, d):
    x = Matrix(table(s, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("long").alias("j"), F.col("p_retailprice").alias("v")), 1 << 40, 64)
    return rounded(lineitems(s, d) @ x)


@query("sparse_diagonal_scale", f"WITH {L_SQL} SELECT l.i, l.j, round(l.v * p_retailprice, 6) + 0.0 AS v FROM l JOIN part ON p_partkey = l.j")
def sparse_diagonal_scale(s, d):
    x = Matrix(table(s, d, "part").select(F.col("p_partkey").alias("i"), F.lit(0).cast("long").alias("j"), F.col("p_retailprice").alias("v")), 1 << 40, 1)
    return rounded(lineitems(s, d).scale_cols(x))


@query("sparse_prune", f"WITH {L_SQL} SELECT i, j, round(v, 6) AS v FROM l WHERE abs(v) > 0.5 * 50")
def sparse_prune(s, d):
    return rounded(lineitems(s, d).pruned(50.0, 0.5))


@query("sparse_transpose", f"WITH {L_SQL} SELECT j AS i, i AS j, round(v, 6) AS v FROM l")
def sparse_transpose(s, d):
    return rounded(lineitems(s, d).transpose())


@query("inner_nonzeros", f"WITH {L_SQL} SELECT j, count(*) AS n FROM l GROUP BY j")
def inner_nonzeros(s, d):
    return lineitems(s, d).colwise(n=F.count("v"))


@query("block_of", f"{EW} SELECT i - 10 AS i, j - 5 AS j, round(v, 6) + 0.0 AS v FROM e WHERE i >= 10 AND i < 30 AND j >= 5 AND j < 15")
def block_of(s, d):
    return rounded(embeddings(s, d).block(10, 5, 20, 10))


@query("right_cols", f"{EW} SELECT i, j - 60 AS j, round(v, 6) + 0.0 AS v FROM e WHERE j >= 60")
def right_cols(s, d):
    return rounded(embeddings(s, d).right_cols(4))


@query("top_rows_reversed", f"{EW} SELECT 19 - i AS i, 63 - j AS j, round(v, 6) + 0.0 AS v FROM e WHERE i < 20")
def top_rows_reversed(s, d):
    return rounded(embeddings(s, d).top_rows(20).reverse())


@query("indexed_gather", f"{EW}, r AS (SELECT * FROM (VALUES (0, 7), (1, 3), (2, 3), (3, 40)) t(p, i)), c AS (SELECT * FROM (VALUES (0, 63), (1, 0)) t(q, j)) SELECT CAST(p AS BIGINT) AS i, CAST(q AS BIGINT) AS j, round(v, 6) + 0.0 AS v FROM e JOIN r USING (i) JOIN c USING (j)")
def indexed_gather(s, d):
    return rounded(embeddings(s, d).indexed([7, 3, 3, 40], [63, 0]))


@query("hcat", f"{EW} SELECT i, j, round(v, 6) + 0.0 AS v FROM e UNION ALL SELECT i, j + 64, round(v, 6) + 0.0 FROM e")
def hcat(s, d):
    e = embeddings(s, d)
    return rounded(e.hcat(e))


@query("replicate", f"{EW}, n AS (SELECT CAST(max(vec_id) + 1 AS BIGINT) AS n FROM embeddings) SELECT i + n * a.range AS i, j + 64 * b.range AS j, round(v, 6) + 0.0 AS v FROM e, n, range(3) a, range(2) b")
def replicate(s, d):
    return rounded(_whole(s, d).replicate(3, 2))


@query("remove_cols", f"{EW} SELECT i, CASE WHEN j >= 10 THEN j - 5 ELSE j END AS j, round(v, 6) + 0.0 AS v FROM e WHERE j < 10 OR j >= 15")
def remove_cols(s, d):
    return rounded(embeddings(s, d).remove_cols(10, 5))


@query("select_mask", f"{EW} SELECT i, j, round(CASE WHEN v > 0 THEN v ELSE -2 * v END, 6) + 0.0 AS v FROM e")
def select_mask(s, d):
    return rounded(embeddings(s, d).map(lambda x: E.select(x > 0, x, -2 * x)))


@query("broadcast_rowwise", f"{EW}, m AS (SELECT j, avg(v) AS w FROM e GROUP BY j) SELECT i, j, round(v - w, 6) + 0.0 AS v FROM e JOIN m USING (j)")
def broadcast_rowwise(s, d):
    e = embeddings(s, d)
    mean = Matrix(e.colwise(v=F.avg("v")).select("j", "v").withColumn("i", F.lit(0).cast("long")).select("i", "j", "v"), 1, 64)
    return rounded(e.broadcast_op(mean, lambda a, b: a - b))


@query("normalize_rows", f"{EW} SELECT i, j, round(v / sqrt(sum(v * v) OVER (PARTITION BY i)), 6) + 0.0 AS v FROM e")
def normalize_rows(s, d):
    return rounded(embeddings(s, d).rowwise_normalized())


@query("embedding_norms", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS l1, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS l2, round(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS linf FROM embeddings")
def embedding_norms(s, d):
    a = F.col("embedding")
    return table(s, d, "embeddings").select("vec_id", r6(E.array_norm(a, 1)).alias("l1"), r6(E.array_norm(a, 2)).alias("l2"), r6(E.array_norm(a, E.INF)).alias("linf"))


@query("rowwise_stats", f"WITH {O_SQL} SELECT i, round(sum(v), 6) AS total, round(min(v), 6) AS low, round(max(v), 6) AS high, round(sqrt(sum(v * v)), 4) AS norm, count(*) AS n FROM o GROUP BY i")
def rowwise_stats(s, d):
    return orders(s, d).rowwise(total=r6(F.sum(v())), low=r6(F.min(v())), high=r6(F.max(v())), norm=F.round(F.sqrt(F.sum(v() * v())), 4), n=F.count(v()))


@query("colwise_stats", f"WITH {O_SQL} SELECT j, round(sum(v), 4) AS total, round(min(v), 6) AS low, round(max(v), 6) AS high, count(*) AS n FROM o GROUP BY j")
def colwise_stats(s, d):
    return orders(s, d).colwise(total=F.round(F.sum(v()), 4), low=r6(F.min(v())), high=r6(F.max(v())), n=F.count(v()))


@query("nan_policies", "SELECT 1.0 AS min, 4.0 AS max, true AS min_is_nan, true AS max_is_nan, true AS has_nan, false AS all_finite")
def nan_policies(s, d):
    m = Matrix(s.createDataFrame([(0, 0, 1.0), (0, 1, float("nan")), (1, 0, 4.0), (1, 1, 2.0)], "i long, j long, v double"), 2, 2)
    df = m.reduce(*[m.aggregate(n) for n in ("min", "max", "min_nan", "max_nan", "has_nan", "all_finite")])
    return df.select("min", "max", F.isnan("min_nan").alias("min_is_nan"), F.isnan("max_nan").alias("max_is_nan"), "has_nan", "all_finite")


@query("argmax_rows", f"{EW} SELECT i, round(max(v), 6) + 0.0 AS v, min(j) FILTER (v = m) AS j FROM (SELECT *, max(v) OVER (PARTITION BY i) AS m FROM e) GROUP BY i")
def argmax_rows(s, d):
    return embeddings(s, d).arg_extreme(True, "i", "row").select("i", r6(v()).alias("v"), "j")


@query("lp_norms", f"{EW} SELECT round(pow(sum(pow(abs(v), 3)), 1.0 / 3), 6) AS l3, (SELECT round(max(abs(v)), 6) FROM e) AS linf FROM e")
def lp_norms(s, d):
    e = embeddings(s, d)
    return e.lp_norm(3).select(r6("norm").alias("l3")).crossJoin(F.broadcast(e.lp_norm(E.INF).select(r6("norm").alias("linf"))))


@query("stable_norm", "SELECT round(sqrt(sum(o_totalprice * o_totalprice)), 2) AS norm FROM orders")
def stable_norm(s, d):
    m = Matrix(table(s, d, "orders").select(F.col("o_orderkey").alias("i"), F.lit(0).cast("long").alias("j"), F.col("o_totalprice").alias("v")), 1 << 40, 1)
    return m.stable_norm().select(F.round("norm", 2).alias("norm"))


@query("dot_product", "SELECT round(sum(c_acctbal * t) / 1e6, 4) AS dot FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def dot_product(s, d):
    zero = F.lit(0).cast("long").alias("j")
    x = Matrix(table(s, d, "customer").select(F.col("c_custkey").alias("i"), zero, F.col("c_acctbal").alias("v")), 1 << 40, 1)
    y = Matrix.from_triplets(table(s, d, "orders").select(F.col("o_custkey").alias("i"), zero, F.col("o_totalprice").alias("v")), 1 << 40, 1)
    return x.dot(y).select(F.round(F.col("dot") / 1e6, 4).alias("dot"))


@query("matvec_embeddings", f"{EW} SELECT i, CAST(0 AS BIGINT) AS j, round(sum(v * (j + 1)), 6) + 0.0 AS v FROM e GROUP BY i")
def matvec_embeddings(s, d):
    return rounded(embeddings(s, d) @ Matrix.linspaced(s, 64, 1.0, 64.0))


@query("cosine_topk", """
WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), u AS (SELECT vec_id, a, sqrt(list_sum(list_transform(a, lambda x: x * x))) AS s FROM n)
SELECT q.vec_id AS i, CAST(rank AS BIGINT) AS rank, b AS j, c AS v FROM (
  SELECT q.vec_id, p.vec_id AS b, round(list_dot_product(q.a, p.a) / (q.s * p.s), 6) AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.a, p.a) / (q.s * p.s), 6) DESC, p.vec_id) AS rank
  FROM u q JOIN u p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id) q WHERE rank <= 5""")
def cosine_topk(s, d):
    """The five nearest vectors by cosine of every fiftieth vector (the stated query set) among all."""
    a = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    a = a.withColumn("n", E.array_norm(F.col("a")))
    q = a.where("vec_id % 50 = 0").toDF("i", "qa", "qn")
    c = F.round(E.dot(F.col("qa"), F.col("a")) / (F.col("qn") * F.col("n")), 6)
    pairs = a.join(q, F.col("vec_id") != F.col("i")).select("i", F.col("vec_id").alias("j"), c.alias("v"))
    w = Window.partitionBy("i").orderBy(F.desc("v"), "j")
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("i", "rank", "j", "v")


G_SQL = "g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM e a JOIN e b USING (i) GROUP BY a.j, b.j)"


def _gram(s, d):
    return Matrix(dense.gram_frame(table(s, d, "embeddings"), "embedding", 64), 64, 64)


@query("rank_update", f"{EW}, {G_SQL} SELECT i, j, round(v + 0.5 * (i + 1) * (j + 1), 6) + 0.0 AS v FROM g")
def rank_update(s, d):
    return rounded(_gram(s, d).rank_update(Matrix.linspaced(s, 64, 1.0, 64.0), 0.5))


@query("kronecker_product", f"{EW}, k AS (SELECT * FROM (VALUES (0, 0, 2.0), (1, 0, -1.0), (1, 1, 0.5)) t(p, q, w)) SELECT e.i * 2 + p AS i, e.j * 2 + q AS j, round(v * CAST(w AS DOUBLE), 6) + 0.0 AS v FROM e, k")
def kronecker_product(s, d):
    return rounded(_whole(s, d).kronecker(Matrix.values(s, [[2.0, 0.0], [-1.0, 0.5]]).pruned()))


@query("outer_product", "SELECT a.range AS i, b.range AS j, (a.range + 1.0) * (b.range + 1.0) AS v FROM range(10) a, range(10) b")
def outer_product(s, d):
    x = Matrix.linspaced(s, 10, 1.0, 10.0)
    return rounded(x.outer(x))


@query("matrix_power", f"{EW}, {G_SQL}, t AS (SELECT sum(v) AS t FROM g WHERE i = j), h AS (SELECT i, j, 8 * v / t AS v FROM g, t), c AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM h x JOIN h y ON x.j = y.i GROUP BY x.i, y.j) SELECT x.i, y.j, round(sum(x.v * y.v), 6) + 0.0 AS v FROM c x JOIN h y ON x.j = y.i GROUP BY x.i, y.j")
def matrix_power(s, d):
    """The cube of the Gram matrix scaled to a trace of 8."""
    g = _gram(s, d)
    return rounded(g.scale(8 / g.df.agg(g.aggregate("trace")).first()[0]).power(3))


@query("linspaced", "SELECT range AS i, CAST(0 AS BIGINT) AS j, CASE WHEN range = 10 THEN 3.0 ELSE 1.0 + range * (3.0 - 1.0) / 10 END AS v FROM range(11)")
def linspaced(s, d):
    return Matrix.linspaced(s, 11, 1.0, 3.0).df.select("i", "j", r6(v()).alias("v"))


@query("equalspaced", "SELECT range AS i, CAST(0 AS BIGINT) AS j, round(0.5 + range * 0.25, 6) AS v FROM range(8)")
def equalspaced(s, d):
    return Matrix.equalspaced(s, 8, 0.5, 0.25).df


@query("identity", "SELECT range AS i, range AS j, 1.0::DOUBLE AS v FROM range(16)")
def identity(s, d):
    return Matrix.identity(s, 16).df


@query("nullary_expression", "SELECT a.range AS i, b.range AS j, CAST(a.range * 10 + b.range AS DOUBLE) AS v FROM range(5) a, range(7) b")
def nullary_expression(s, d):
    return Matrix.generate(s, 5, 7, lambda i, j: i * 10 + j).df


@query("random_uniform", "SELECT CAST(100000 AS BIGINT) AS n, true AS inside, true AS centred, true AS spread")
def random_uniform(s, d):
    """Number, range, mean 0 and mean square 1/3 of uniform values."""
    m = Matrix.random(s, 10_000, 10, 7)
    return m.reduce(F.count("v").alias("n"), ((F.min("v") >= -1) & (F.max("v") <= 1)).alias("inside"), (F.abs(F.avg("v")) < 0.01).alias("centred"), (F.abs(F.avg(v() * v()) - 1 / 3) < 0.01).alias("spread"))


@query("top_k_by_magnitude", f"WITH {O_SQL} SELECT i, j, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY abs(v) DESC, i, j) AS r FROM o) WHERE r <= 2")
def top_k_by_magnitude(s, d):
    return rounded(orders(s, d).top_k(2))


@query("is_approx", "SELECT true AS is_approx")
def is_approx(s, d):
    e = embeddings(s, d)
    return e.is_approx(e.map(lambda x: x * (1 + 1e-14)))


@query("matrix_equal", "SELECT true AS equal")
def matrix_equal(s, d):
    e = embeddings(s, d)
    return e.equals(e.transpose().transpose())


@query("block_sparse_round_trip", f"WITH {O_SQL} SELECT i, j, round(v, 6) AS v FROM o WHERE v <> 0")
def block_sparse_round_trip(s, d):
    o = orders(s, d)
    return rounded(Matrix.from_blocks(o.blocks(4), 4, o.rows, o.cols))


@query("compensated_sum", "SELECT round(fsum(o_totalprice), 4) AS total FROM orders")
def compensated_sum(s, d):
    """Kahan-like: high and low parts are summed apart as exact decimals."""
    return table(s, d, "orders").agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(30,10)")).cast("double"), 4).alias("total"))


NW = f"{EW}, n AS (SELECT CAST(max(vec_id) + 1 AS BIGINT) AS n FROM embeddings)"


def _whole(s, d):
    """All vectors, with the extent counted."""
    return Matrix(embeddings(s, d).df, table(s, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1, 64)


@query("diagonal_of", f"{EW} SELECT i, CAST(0 AS BIGINT) AS j, round(v, 6) + 0.0 AS v FROM e WHERE j - i = 2")
def diagonal_of(s, d):
    return rounded(_whole(s, d).diagonal(2))


@query("triangular_view", f"{EW} SELECT i, j, round(v, 6) + 0.0 AS v FROM e WHERE i >= j")
def triangular_view(s, d):
    return rounded(_whole(s, d).triangular("lower"))


@query("unit_upper_view", f"{NW} SELECT i, j, round(v, 6) + 0.0 AS v FROM e WHERE i < j UNION ALL SELECT range, range, 1.0 FROM range(64), n WHERE range < n")
def unit_upper_view(s, d):
    return rounded(_whole(s, d).triangular("unit_upper"))


@query("selfadjoint_mirror", f"WITH {L_SQL} SELECT i, j, round(v, 6) + 0.0 AS v FROM l WHERE i >= j UNION ALL SELECT j, i, round(v, 6) + 0.0 FROM l WHERE i > j")
def selfadjoint_mirror(s, d):
    """Of the square matrix of all line items: the embeddings are not square."""
    return rounded(lineitems(s, d).selfadjoint("lower"))


@query("banded_view", f"{EW} SELECT i, j, round(v, 6) + 0.0 AS v FROM e WHERE i - j <= 1 AND j - i <= 2")
def banded_view(s, d):
    return rounded(_whole(s, d).banded(1, 2))


@query("permute_rows", f"{NW} SELECT n - 1 - i AS i, j, round(v, 6) + 0.0 AS v FROM e, n")
def permute_rows(s, d):
    e = _whole(s, d)
    p = table(s, d, "embeddings").select(F.col("vec_id").alias("i"), (e.rows - 1 - F.col("vec_id")).alias("p"))
    return rounded(e.permuted(left=p))


@query("twisted_by", f"WITH {L_SQL} SELECT xor(i, CAST(1 AS BIGINT)) AS i, xor(j, CAST(1 AS BIGINT)) AS j, round(v, 6) + 0.0 AS v FROM l")
def twisted_by(s, d):
    m = lineitems(s, d)
    ids = m.df.select("i").union(m.df.select("j")).distinct()
    return rounded(m.twisted_by(ids.select("i", F.col("i").bitwiseXOR(F.lit(1)).alias("p"))))


@query("vcat", f"{NW} SELECT i, j, round(v, 6) + 0.0 AS v FROM e UNION ALL SELECT i + n, j, round(v, 6) + 0.0 FROM e, n")
def vcat(s, d):
    e = _whole(s, d)
    return rounded(e.vcat(e))


@query("reshape_colmajor", f"{NW} SELECT (i + j * n) % (2 * n) AS i, (i + j * n) // (2 * n) AS j, round(v, 6) + 0.0 AS v FROM e, n")
def reshape_colmajor(s, d):
    e = _whole(s, d)
    return rounded(e.reshaped(2 * e.rows, 32))


@query("reshape_rowmajor", f"{EW} SELECT (i * 64 + j) // 32 AS i, (i * 64 + j) % 32 AS j, round(v, 6) + 0.0 AS v FROM e")
def reshape_rowmajor(s, d):
    e = _whole(s, d)
    return rounded(e.reshaped(2 * e.rows, 32, "row"))


@query("full_reductions", f"{NW} SELECT round(sum(v), 6) + 0.0 AS sum, round(sum(v) / (64 * any_value(n)), 6) + 0.0 AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(sqrt(sum(v * v)), 6) AS norm, round(sum(abs(v)), 6) AS l1, round(max(abs(v)), 6) AS linf, round(sum(v) FILTER (i = j), 6) + 0.0 AS trace, count(*) AS nonzeros, bool_and(v <> 0) AS all, bool_or(v <> 0) AS any FROM e, n")
def full_reductions(s, d):
    b = _whole(s, d)
    names = ["sum", "mean", "min", "max", "norm", "l1", "linf", "trace"]
    return b.reduce(*[r6(b.aggregate(n)).alias(n) for n in names], *[b.aggregate(n) for n in ("nonzeros", "all", "any")])


@query("argmin_all", f"{NW} SELECT i, j, round(v, 6) AS v FROM e, n ORDER BY e.v, i + j * n LIMIT 1")
def argmin_all(s, d):
    return _whole(s, d).arg_extreme(False).select("i", "j", r6(v()).alias("v"))


@query("to_dense", f"WITH {O_SQL}, a AS (SELECT unnest(range((SELECT max(o_custkey) + 1 FROM orders))) AS i) SELECT a.i, b.range AS j, round(coalesce(v, 0), 6) + 0.0 AS v FROM a CROSS JOIN range(5) b LEFT JOIN o ON o.i = a.i AND o.j = b.range")
def to_dense(s, d):
    return rounded(Matrix(orders(s, d).df, table(s, d, "orders").agg(F.max("o_custkey")).first()[0] + 1, 5).to_dense())


@query("shape_tests", "SELECT true AS lower_triangular, false AS diagonal")
def shape_tests(s, d):
    t = _whole(s, d).triangular("lower")
    return t.shape_test("lower_triangular").crossJoin(t.shape_test("diagonal"))


@query("sorted_vector", f"{EW} SELECT i, row_number() OVER (PARTITION BY i ORDER BY v) - 1 AS place, round(v, 6) + 0.0 AS v FROM e")
def sorted_vector(s, d):
    sorted_rows = table(s, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode(F.sort_array("embedding")).alias("place", "v"))
    return sorted_rows.select("i", F.col("place").cast("long").alias("place"), r6(F.col("v").cast("double")).alias("v"))


@query("degree_ordering", f"WITH {O_SQL} SELECT i, row_number() OVER (ORDER BY count(*), i) AS place FROM o GROUP BY i")
def degree_ordering(s, d):
    """Places from counts by (degree, block of ids) and ranks within them; no task holds all rows."""
    degrees = orders(s, d).rowwise(n=F.count("v")).withColumn("b", F.floor(F.col("i") / (1 << 20)))
    counts = degrees.groupBy("n", "b").agg(F.count("*").alias("c"))
    before = Window.orderBy("n", "b").rowsBetween(Window.unboundedPreceding, -1)  # over a row per (degree, block)
    counts = counts.select("n", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("n", "b").orderBy("i"))
    return degrees.withColumn("r", inner).join(F.broadcast(counts), ["n", "b"]).select("i", (F.col("r") + F.col("before")).cast("long").alias("place"))


def _tax(s, d):
    """The second operand of the sparse queries: the tax of all lines, duplicates summed."""
    df = table(s, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_tax").alias("v"))
    return Matrix.from_triplets(df, 1 << 40, 1 << 40)


X_SQL = "t AS (SELECT l_orderkey AS i, l_partkey AS j, sum(l_tax) AS v FROM lineitem GROUP BY ALL)"


@query("sparse_add", f"WITH {L_SQL}, {X_SQL} SELECT i, j, round(coalesce(l.v, 0) + coalesce(t.v, 0), 6) + 0.0 AS v FROM l FULL JOIN t USING (i, j)")
def sparse_add(s, d):
    return rounded(lineitems(s, d) + _tax(s, d))


@query("sparse_sub", f"WITH {L_SQL}, {X_SQL} SELECT i, j, round(coalesce(l.v, 0) - coalesce(t.v, 0), 6) + 0.0 AS v FROM l FULL JOIN t USING (i, j)")
def sparse_sub(s, d):
    return rounded(lineitems(s, d) - _tax(s, d))


@query("sparse_union_op", f"WITH {L_SQL}, {X_SQL} SELECT i, j, round(greatest(coalesce(l.v, 0), coalesce(t.v, 0)), 6) + 0.0 AS v FROM l FULL JOIN t USING (i, j)")
def sparse_union_op(s, d):
    return rounded(lineitems(s, d).union_op(_tax(s, d), F.greatest))


@query("sparse_hadamard", f"WITH {L_SQL}, {X_SQL} SELECT i, j, round(l.v * t.v, 6) + 0.0 AS v FROM l JOIN t USING (i, j)")
def sparse_hadamard(s, d):
    return rounded(lineitems(s, d).cwise_product(_tax(s, d)))


@query("sparse_quotient", f"WITH {L_SQL}, {X_SQL} SELECT i, j, round(l.v / t.v, 6) AS v FROM l JOIN t USING (i, j) WHERE t.v <> 0")
def sparse_quotient(s, d):
    return rounded(lineitems(s, d).cwise_quotient(_tax(s, d).prune(lambda i, j, x: x != 0)))


@query("sparse_disjunction", f"WITH {L_SQL}, {X_SQL} SELECT i, j, round(CASE WHEN l.v IS NULL THEN t.v WHEN t.v IS NULL THEN l.v ELSE l.v * t.v END, 6) + 0.0 AS v FROM l FULL JOIN t USING (i, j)")
def sparse_disjunction(s, d):
    return rounded(lineitems(s, d).disjunction(_tax(s, d), lambda a, b: a * b))
