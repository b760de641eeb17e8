"""Matrices and tensors against NumPy, sources, streaming and distributed solvers."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veldt.functions import geometry as G
from veldt.operators import dense, fit, solvers, sparse_direct, spatial
from veldt.operators.blocks import BlockMatrix
from veldt.operators.matrix import Matrix
from veldt.operators.tensor import Tensor
from veldt.plans import catalog
from veldt.plans.more_queries import Corner, Spread
from veldt.sources import market
from veldt.streaming import incremental

RNG = np.random.default_rng(7)


def to_numpy(m):
    out = np.zeros((m.rows, m.cols))
    for r in m.df.collect():
        out[r["i"], r["j"]] += r["v"]
    return out


def matrix(spark, a):
    return Matrix.values(spark, a.tolist())


def tensor(spark, a):
    rows = [(*map(int, k), float(x)) for k, x in np.ndenumerate(a)]
    return Tensor(spark.createDataFrame(rows, ", ".join(f"d{k} long" for k in range(a.ndim)) + ", v double"), a.shape)


def tensor_numpy(t):
    out = np.zeros(t.dims)
    for r in t.df.collect():
        out[tuple(r[k] for k in range(t.rank))] += r["v"]
    return out


def test_matrix_operations(spark):
    x, y = RNG.standard_normal((4, 5)), RNG.standard_normal((4, 5))
    a, b = matrix(spark, x), matrix(spark, y)
    for got, want in (
        (a + b, x + y), (a - b, x - y), (a @ b.transpose(), x @ y.T), (a.gram(), x.T @ x), (a.kronecker(b), np.kron(x, y)), (a.reshaped(10, 2), x.reshape(10, 2, order="F")), (a.reshaped(2, 10, "row"), x.reshape(2, 10)),
        (a.reverse(), x[::-1, ::-1]), (a.corner("bottom_right", 2, 3), x[2:, 2:]), (a.indexed([3, 0, 0], None), x[[3, 0, 0]]), (a.replicate(2, 3), np.tile(x, (2, 3))), (a.rowwise_normalized(), x / np.linalg.norm(x, axis=1)[:, None]),
        (a.normalized(), x / np.linalg.norm(x)), (a.insert_empty_cols(2, 1), np.insert(x, 2, 0, axis=1)), (a.diagonal(1), np.diag(x, 1)[:, None]), (a.scale_rows(matrix(spark, y[:, :1])), x * y[:, :1]), (a.hcat(b), np.hstack([x, y])), (a.vcat(b), np.vstack([x, y])),
    ):
        assert np.allclose(to_numpy(got), want)
    s = to_numpy(a.scaled(8)[0])
    assert np.abs(s).max() <= 1.2


def test_empty_matrix(spark):
    z = Matrix.zero(spark, 3, 3)
    row = z.reduce(*[z.aggregate(n) for n in ("sum", "norm", "max", "nonzeros", "any", "all")]).first()
    assert (row["sum"], row["norm"], row["max"], row["nonzeros"], row["any"], row["all"]) == (0, 0, 0, 0, False, False)
    assert z.shape_test("zero").first()[0] and not to_numpy(z @ z).any()


def test_tensor_operations(spark):
    x = RNG.standard_normal((3, 4, 5))
    t = tensor(spark, x)
    y = RNG.standard_normal((5, 4, 2))
    for got, want in (
        (t.shuffle((2, 0, 1)), x.transpose(2, 0, 1)), (t.slice((1, 0, 2), (2, 3, 3)), x[1:3, 0:3, 2:5]), (t.strided_slice((0, 3, 0), (3, 0, 5), (2, -1, 2)), x[0:3:2, 3:0:-1, 0:5:2]), (t.chip(1, 2), x[:, 2]), (t.roll((0, 1, 2)), np.roll(x, (0, -1, -2), (0, 1, 2))),
        (t.pad(((1, 0), (0, 2), (0, 0)), 3.0), np.pad(x, ((1, 0), (0, 2), (0, 0)), constant_values=3)), (t.broadcast((2, 1, 2)), np.tile(x, (2, 1, 2))), (t.stride((2, 1, 3)), x[::2, :, ::3]), (t.reshape((6, 10)), x.reshape((6, 10), order="F")), (t.cumsum(2), x.cumsum(2)),
        (t.cumprod(1), x.cumprod(1)), (t.cumsum(1, exclusive=True), x.cumsum(1) - x), (t.sum([0, 2]), x.sum((0, 2))), (t.maximum([1]), x.max(1)), (t.mean([2]), x.mean(2)), (t.prod([0]), x.prod(0)), (t.contract(tensor(spark, y), [(2, 0), (1, 1)]), np.einsum("abc,cbd->ad", x, y)),
        (t.fft([2], part="imag"), np.fft.fft(x, axis=2).imag), (t.zip(t, lambda a, b: a * b), x * x), (t.concatenate(t, 1), np.concatenate([x, x], 1)),
    ):
        assert np.allclose(tensor_numpy(got), want)
    assert (tensor_numpy(t.arg_extreme(1)) == x.argmax(1)).all()
    square = tensor(spark, np.arange(12.0).reshape(2, 2, 3) + 1)
    assert tensor_numpy(square.trace((0, 1))).tolist() == [11, 13, 15]
    ones = Tensor.generate(spark, (2, 3), lambda a, b: a + b)
    same = ones.image_patches((0, 1), (2, 2), (1, 1), padding="same", pad_value=5.0)
    assert same.dims == (2, 2, 6) and same.df.count() == 24


def test_ties_go_to_the_first(spark):
    m = Matrix.values(spark, [[1, 4, 8], [3, 4, 2]])
    assert [r["i"] for r in m.arg_extreme(True, "j").orderBy("j").collect()] == [1, 0, 0]
    t = Tensor.from_matrix(m)
    assert t.arg_extreme().first()[0] == 4


def test_triplet_merges(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 1), (0, 0, 5.0, 2), (1, 0, 2.0, 3)], "i long, j long, v double, seq int")
    assert to_numpy(Matrix.from_triplets(df, 2, 1)).tolist() == [[6], [2]]
    assert to_numpy(Matrix.from_triplets(df, 2, 1, "last", F.col("seq"))).tolist() == [[5], [2]]
    m = Matrix.from_triplets(df, 2, 1)
    assert to_numpy(m.insert_triplets(df.drop("seq").where("i = 1"), "last")).tolist() == [[6], [2]]


def test_market_files(spark, tmp_path):
    x = np.round(RNG.standard_normal((7, 5)), 3)
    x[x < 0] = 0
    m = Matrix(matrix(spark, x).df.where("v != 0"), 7, 5)
    market.save_sparse(m, str(tmp_path / "s.mtx"))
    back = market.load_sparse(spark, str(tmp_path / "s.mtx"))
    assert (back.rows, back.cols) == (7, 5) and np.allclose(to_numpy(back), x)
    market.save_dense(m, str(tmp_path / "d.mtx"))
    assert np.allclose(to_numpy(market.load_dense(spark, str(tmp_path / "d.mtx"))), x)
    (tmp_path / "bad.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% comment\n2 2 2\n1 1 1.5\n3 1 2\n")
    assert market.header(spark, str(tmp_path / "bad.mtx")).symmetry == "symmetric"
    with pytest.raises(ValueError):
        market.load_sparse(spark, str(tmp_path / "bad.mtx"))


def test_dense_blocks(spark):
    x = RNG.standard_normal((6, 6))
    a = matrix(spark, x)
    assert np.allclose(to_numpy(dense.matrix_function(a, "inverse")), np.linalg.inv(x))
    assert np.allclose(to_numpy(dense.solve(matrix(spark, x + x.T), matrix(spark, (x + x.T) @ x[:, :2]), "bunch_kaufman")), x[:, :2]) and np.allclose(to_numpy(dense.solve(a, matrix(spark, x @ x[:, :1]), "cod")), x[:, :1])
    assert dense.scalar(a, "determinant").first()[0] == pytest.approx(np.linalg.det(x))
    b = RNG.standard_normal((6, 2))
    for kind, m in (("lu", x), ("qr", x), ("lower", np.tril(x)), ("unit_upper", np.triu(x, 1) + np.eye(6)), ("ldlt", x @ x.T + np.eye(6))):
        got = to_numpy(dense.solve(matrix(spark, m), matrix(spark, m @ b), kind))
        assert np.allclose(got, b, atol=1e-6), kind
    with pytest.raises(ValueError):
        dense.scalar(Matrix.zero(spark, 1 << 20, 1 << 20), "determinant")
    rows = spark.createDataFrame([(r.tolist(),) for r in RNG.standard_normal((50, 4))], "row array<double>")
    y = np.vstack([r["row"] for r in rows.collect()])
    assert np.allclose(to_numpy(Matrix(dense.tsqr_r(rows, "row", 4), 4, 4)).T @ to_numpy(Matrix(dense.tsqr_r(rows, "row", 4), 4, 4)), y.T @ y)


def test_distributed_solvers(spark):
    n = 12
    x = np.diag(np.full(n, 2.0)) + np.diag(np.full(n - 1, -1.0), 1) + np.diag(np.full(n - 1, -1.0), -1)
    m, truth = matrix(spark, x), np.arange(1.0, n + 1)
    got, k, _ = solvers.conjugate_gradient_distributed(m, matrix(spark, (x @ truth)[:, None]), 1e-10)
    assert k <= n and np.allclose(to_numpy(got)[:, 0], truth, atol=1e-5)
    tall = RNG.standard_normal((15, 4))
    op = solvers.Operator(matrix(spark, tall))
    b = RNG.standard_normal(15)
    want = np.linalg.lstsq(tall, b, rcond=None)[0]
    assert np.allclose(solvers.lscg(op, b, tolerance=1e-12).x, want) and np.allclose(solvers.lsmr(op, b, tolerance=1e-12).x, want)


def test_power_iteration(spark, sf):
    a = np.stack(spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()["embedding"]).astype(float)
    a = a.T @ a + np.eye(64)
    assert solvers.power_iteration(lambda x: a @ x, 64)[0] == pytest.approx(np.linalg.eigvalsh(a)[-1])
    with pytest.raises(ArithmeticError):
        solvers.power_iteration(lambda x: a @ x, 64, 15)
    assert solvers.power_iteration(lambda x: 0 * x, 64)[0] == 0


def test_whole_table_queries(spark, sf):
    a = np.stack(spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()["embedding"]).astype(float)
    (row,) = catalog.QUERIES["argmin_all"](spark, sf).collect()
    assert (row["i"], row["j"]) == np.unravel_index(a.argmin(), a.shape)
    (row,) = catalog.QUERIES["full_reductions"](spark, sf).collect()
    assert (row["min"], row["max"], row["nonzeros"]) == (round(a.min(), 6), round(a.max(), 6), a.size)
    assert catalog.QUERIES["sorted_vector"](spark, sf).count() == a.size
    customers = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct().count()
    assert catalog.QUERIES["degree_ordering"](spark, sf).count() == customers > 0


def test_whole_tensor_queries(spark, sf):
    a = np.stack(spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()["embedding"]).astype(float)
    (row,) = catalog.QUERIES["tensor_argmax_flat"](spark, sf).collect()
    assert row["v"] == a.argmax()
    assert catalog.QUERIES["tensor_cumsum"](spark, sf).count() == a.size
    assert catalog.QUERIES["cumprod_series"](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_whole_sparse_operands(spark, sf):
    """Every cell of the lines is in both operands."""
    cells = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().count()
    assert catalog.QUERIES["sparse_hadamard"](spark, sf).count() == cells > 0


def test_fits(spark):
    x = RNG.standard_normal((30, 2))
    pairs = spark.createDataFrame([(*map(float, p), float(3 * p[1] + 1), float(-3 * p[0] + 2)) for p in x], "a double, b double, c double, d double")
    m = fit.umeyama(pairs, ["a", "b"], ["c", "d"])
    assert np.allclose(m, [[0, 3, 1], [-3, 0, 2], [0, 0, 1]])


def test_quaternions(spark):
    unit = spark.range(1).select(G.q_normalized(G.quaternion(1.0, 2.0, 3.0, 4.0)).alias("q"), F.rand().alias("r"))
    unit, q = unit.select("r", "q").distinct(), F.col("q")  # a shuffle keeps the value from being inlined
    row = unit.withColumn("m", G.q_matrix(q)).select(G.q_dot(q, q).alias("n"), G.q_mul(q, G.q_inverse(q))["w"].alias("w"), G.det3(F.col("m")).alias("d"), G.q_angular_distance(q, q).alias("a"), G.q_dot(G.q_slerp(q, q, F.lit(0.3)), q).alias("s")).first()
    assert [round(row[k], 9) for k in range(5)] == [1, 1, 1, 0, 1]


def test_streaming(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 1, 3.0)], "i long, j long, v double").write.parquet(source)
    stream = spark.readStream.schema("i long, j long, v double").parquet(source)
    q = stream.writeStream.foreachBatch(incremental.merge_into(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["i"], r["v"]) for r in incremental.merged(spark, str(tmp_path / "out")).collect()} == {(0, 3.0), (1, 3.0)}


def sparse(spark, a):
    i, j = np.nonzero(a)
    return Matrix(spark.createDataFrame([(int(p), int(q), float(a[p, q])) for p, q in zip(i, j)], "i long, j long, v double"), *a.shape)


def test_extremes_with_structural_zeros(spark):
    for a in (np.array([[-2.0, 0], [0, -3]]), np.array([[-2.0, -1], [-4, -3]]), np.array([[0.0, 0, 5], [0, -1, 0], [-2, -2, -2], [1, 2, 3]]), np.array([[0.0, -1, 0, -7]])):
        m = sparse(spark, a)
        for largest in (True, False):
            best = (a if largest else -a).T.ravel().argmax()  # column order
            row = m.arg_extreme(largest).first()
            assert (row["i"], row["j"], row["v"]) == (best % a.shape[0], best // a.shape[0], a.T.ravel()[best])
            by_row = (a if largest else -a).argmax(1)
            assert {r["i"]: (r["j"], r["v"]) for r in m.arg_extreme(largest, "i", "row").collect()} == {k: (by_row[k], a[k, by_row[k]]) for k in range(len(a)) if a[k].any()}
            by_col = (a if largest else -a).argmax(0)
            assert {r["j"]: (r["i"], r["v"]) for r in m.arg_extreme(largest, "j").collect()} == {k: (by_col[k], a[by_col[k], k]) for k in range(a.shape[1]) if a[:, k].any()}
        got = {r["i"]: (r["max"], r["min"], r["mean"], r["prod"]) for r in m.rowwise("max", "min", "mean", "prod").collect()}
        assert got == {k: (r.max(), r.min(), r.mean(), r.prod()) for k, r in enumerate(a) if r.any()}


@pytest.mark.parametrize("block", [1, 2, 3, 1 << 20])
def test_scans_of_sparse_lines(spark, block):
    line = np.array([2.0, 0, 3, 0, 0, 4, 1])
    table_ = np.array([[1.0, 2, 3, 0], [0, 5, 6, 7], [0, 0, 0, 0], [2, 0, 0, 3]])
    for a, axis in ((line, 0), (table_, 0), (table_, 1)):
        i = np.argwhere(a)
        t = Tensor(spark.createDataFrame([(*map(int, k), float(a[tuple(k)])) for k in i], ", ".join(f"d{k} long" for k in range(a.ndim)) + ", v double"), a.shape)
        shift = lambda x, first: np.concatenate([np.full_like(np.take(x, [0], axis), first), np.delete(x, -1, axis)], axis)
        assert np.allclose(tensor_numpy(t.cumsum(axis, block=block)), a.cumsum(axis))
        assert np.allclose(tensor_numpy(t.cumsum(axis, exclusive=True, block=block)), shift(a.cumsum(axis), 0))
        assert np.allclose(tensor_numpy(t.cumprod(axis, block=block)), a.cumprod(axis))
        assert np.allclose(tensor_numpy(t.cumprod(axis, exclusive=True, block=block)), shift(a.cumprod(axis), 1))
    t = Tensor(spark.createDataFrame([(int(k), float(line[k])) for k in np.flatnonzero(line)], "d0 long, v double"), (1 << 40,))
    assert [r["v"] for r in t.cumsum(0, stored=True, block=block).df.orderBy("d0").collect()] == [2, 5, 9, 10]
    assert [r["v"] for r in t.cumsum(0, exclusive=True, stored=True, block=block).df.orderBy("d0").collect()] == [0, 2, 5, 9]
    assert [r["v"] for r in t.cumprod(0, stored=True, block=block).df.orderBy("d0").collect()] == [2, 6, 24, 24]
    with pytest.raises(ValueError):
        t.cumsum(0)


def test_a_long_line_is_scanned_in_many_tasks(spark):
    n = 1 << 21
    t = Tensor(spark.range(n).select(F.col("id").alias("d0"), F.lit(1.0).alias("v")), (n,))
    run = t.cumsum(0, stored=True, block=1 << 16)
    assert run.df.where("v != d0 + 1").isEmpty()
    assert "_b" in run.df._jdf.queryExecution().optimizedPlan().toString()


def test_four_step_fft(spark):
    x = RNG.standard_normal((3, 60))
    t = tensor(spark, x)
    want = np.fft.fft(x, axis=1)
    for line in (60, 12, 10):
        assert np.allclose(tensor_numpy(t.fft([1], part="real", line=line)), want.real) and np.allclose(tensor_numpy(t.fft([1], part="imag", line=line)), want.imag)
        assert np.allclose(tensor_numpy(t.fft([1], inverse=True, part="imag", line=line, scaled=False)), np.fft.ifft(x, axis=1).imag * 60)
    half = t.fft([1], part="real", half=True)
    assert half.dims == (3, 31) and np.allclose(tensor_numpy(half), want.real[:, :31])
    with pytest.raises(ValueError):
        tensor(spark, RNG.standard_normal(61)).fft([0], line=10)


def test_sparse_direct_on_dataframes(spark):
    a = np.where(RNG.random((15, 15)) < 0.2, RNG.standard_normal((15, 15)), 0) + np.diag(np.full(15, 5.0))
    x = RNG.standard_normal((15, 2))
    s = a + a.T
    for kind, m in (("llt", s), ("ldlt", s), ("lu", a), ("qr", a), ("lower", np.tril(a)), ("unit_upper", np.triu(a, 1) + np.eye(15))):
        got = sparse_direct.solve(sparse(spark, m), matrix(spark, m @ x), kind)
        assert np.allclose(to_numpy(got), x), kind
    for lower in (True, False):
        t = np.tril(a) if lower else np.triu(a)
        got, levels = sparse_direct.level_solve(sparse(spark, t), matrix(spark, t @ x[:, :1]), lower)
        assert np.allclose(to_numpy(got), x[:, :1]) and 1 <= levels <= 15
    with pytest.raises(ArithmeticError):
        sparse_direct.level_solve(sparse(spark, np.tril(a) - np.diag([5.0, *[0] * 14]) - np.diag([a[0, 0] - 5, *[0] * 14])), matrix(spark, x[:, :1]))


def test_block_sparse(spark):
    a, b = (np.where(RNG.random((10, 10)) < 0.3, RNG.standard_normal((10, 10)), 0) for _ in range(2))
    p, q = BlockMatrix.of(sparse(spark, a), 4), BlockMatrix.of(sparse(spark, b), 4)
    for got, want in ((p @ q, a @ b), (p + q, a + b), (p - q, a - b), (p.conjunction(q), a * b), (p.transpose(), a.T), (p.triangular("strictly_upper"), np.triu(a, 1)), (p.selfadjoint("lower"), np.tril(a) + np.tril(a, -1).T), (p.map(lambda x: x * 3), 3 * a)):
        assert np.allclose(to_numpy(got.matrix()), want)
    assert np.allclose(to_numpy(p.diagonal())[:, 0], np.diag(a)) and np.allclose(to_numpy(p.times(matrix(spark, b))), a @ b)


def test_reducers_and_visitors(spark):
    a = np.where(RNG.random((6, 5)) < 0.5, RNG.standard_normal((6, 5)), 0)
    m = sparse(spark, a)
    assert {r["i"]: round(r["v"], 9) for r in m.reduce_with(Spread(), "i").collect()} == {k: round(float(r.var()), 9) for k, r in enumerate(a) if r.any()}
    assert m.reduce_with(Spread()).first()["v"] == pytest.approx(a.var())
    assert m.visit(Corner()).first()["state"][0] == pytest.approx((a * (np.arange(5) + 1)).sum())
    assert Matrix.zero(spark, 3, 3).visit(Corner()).first()["state"] == [0, -1, -1]
    assert sorted((i, j) for i, j, _ in m.entries()) == sorted(zip(*map(lambda x: x.tolist(), np.nonzero(a))))
    assert m.sorted_inner().transform(lambda df: Matrix(df, 6, 5).inner_indices_sorted()).first()[0]


def test_market_problems(spark, tmp_path):
    for name in ("p_SPD.mtx", "p_b.mtx", "p_x.mtx", "q.mtx", "note.txt"):
        (tmp_path / name).write_text("%%MatrixMarket matrix coordinate real general\n1 1 1\n1 1 2\n")
    found = market.load_problems(spark, str(tmp_path))
    assert [(n, b is not None, x is not None) for n, _, b, x in found] == [("p_SPD", True, True), ("q", False, False)]


def test_nearest_far_out(spark):
    """Queries far from all points, and from each other, meet few of them."""
    points = spark.createDataFrame([(k, float(k % 40), float(k // 40)) for k in range(800)], "id long, x double, y double")
    queries = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate([(0.2, 0.1), (1e4, -3e3), (-5e5, 7.0), (20.4, 10.3), (39.0, 1e6)])], "id long, x double, y double")
    q, p = queries.toPandas(), points.toPandas()
    want = {}
    for r in q.itertuples():
        dist = np.hypot(p.x - r.x, p.y - r.y)
        want[r.id] = (int(p.id[dist.argmin()]), pytest.approx(dist.min()))
    assert {r["a"]: (r["b"], r["distance"]) for r in spatial.nearest(queries, points, ["x", "y"], 1.0).collect()} == want
    assert spatial.nearest(queries, points.where("false"), ["x", "y"], 1.0).count() == 0


def test_wide_balls(spark):
    r = np.where(RNG.random(60) < 0.2, 30.0, 0.5)
    xy = RNG.uniform(-50, 50, (60, 2))
    df = spark.createDataFrame([(k, *map(float, xy[k]), float(r[k])) for k in range(60)], "id long, x double, y double, r double")
    want = {(a, b) for a in range(60) for b in range(60) if np.hypot(*(xy[a] - xy[b])) <= r[a] + r[b]}
    got = [(x["a"], x["b"]) for x in spatial.overlapping_pairs(df, df, ["x", "y"], 0.7).collect()]
    assert set(got) == want and len(got) == len(want)
    some = spatial.overlapping_pairs(df, df, ["x", "y"], 0.7, test=lambda a, b: a < b).count()
    assert some == sum(a < b for a, b in want)


def joined_rows(spark, action, node_name="Join", metric="number of output rows"):
    """Rows that the joins of the action's jobs made, or another sum over nodes of a kind."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    result = action()
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(30_000)
    runs, total = store.executionsList(), 0
    for run in (runs.apply(n).executionId() for n in range(before, runs.size())):
        nodes, found = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(n) for n in range(nodes.size())):
            metrics = [node.metrics().apply(n) for n in range(node.metrics().size())] if node_name in node.name() else []
            total += sum(int(found.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == metric and found.contains(m.accumulatorId()))
    return result, total


def crowd(spark, n, copies, seed):
    """n places in one cell and one far out, each held by `copies` keys."""
    xy = np.vstack([np.random.default_rng(seed).uniform(0.5, 3.5, (n - 1, 2)), [[4e3, -9e3]]])
    df = pd.DataFrame([(k * n + i, *map(float, xy[i])) for k in range(copies) for i in range(n)], columns=["id", "x", "y"])
    return df, spark.createDataFrame(df)


def test_closest_pair_in_a_crowded_cell(spark):
    """All places lie in one cell, in copies: few pairs are made, and ties go to the smallest keys."""
    (p, left), (q, right) = crowd(spark, 700, 3, 1), crowd(spark, 600, 4, 2)
    got, pairs = joined_rows(spark, lambda: spatial.closest_pair(left, right, ["x", "y"], 4.0).collect())
    p, q = p[:699], q[:599]
    dist = np.sqrt((p.x.values[:, None] - q.x.values) ** 2 + (p.y.values[:, None] - q.y.values) ** 2)
    a, b = np.unravel_index(dist.argmin(), dist.shape)
    far = 0.0  # both sets hold the same far place
    assert [tuple(r) for r in got] == [(699, 599, far)] and dist[a, b] > 0
    assert pairs < 100_000  # 2,100 x 2,400 before
    got = spatial.closest_pair(left.where("x < 5"), right.where("x < 5"), ["x", "y"], 4.0).collect()
    assert [tuple(r) for r in got] == [(a, b, pytest.approx(dist[a, b], rel=1e-12))]
    assert [tuple(r) for r in spatial.closest_pair(left, right.where("false"), ["x", "y"], 4.0).collect()] == []


def test_nearest_in_a_crowded_cell(spark):
    """Keys at one place share its search; distances of 0 and ties go to the smallest key; a far place is found as well."""
    (p, left), (q, right) = crowd(spark, 700, 3, 1), crowd(spark, 600, 4, 2)
    got, pairs = joined_rows(spark, lambda: spatial.nearest(left, right, ["x", "y"], 4.0).collect())
    dist = np.sqrt((p.x.values[:, None] - q.x.values) ** 2 + (p.y.values[:, None] - q.y.values) ** 2)
    at = dist.argmin(axis=1)
    assert {r["a"]: (r["b"], r["distance"]) for r in got} == {k: (b, pytest.approx(dist[k, b], rel=1e-12)) for k, b in enumerate(at)} and len(got) == len(p)
    assert pairs < 100_000  # 2,100 x 2,400 before
    lost = left.unionByName(spark.createDataFrame([(-1, None, 1.0), (-2, float("nan"), 1.0)], left.schema))
    assert spatial.nearest(lost, right, ["x", "y"], 4.0).count() == len(p)


def test_nearest_shuffles_no_queries(spark):
    """With different places, too: queries meet the listed points of their cells where they lie; only their keys are dealt out, once."""
    rng = np.random.default_rng(3)
    p, q = (pd.DataFrame({"id": np.arange(n), "x": rng.uniform(-10, 100, n).round(2), "y": rng.integers(0, 25, n).astype(float)}) for n in (20_000, 1_000))
    got, dealt = joined_rows(spark, lambda: spatial.nearest(spark.createDataFrame(p), spark.createDataFrame(q), ["x", "y"], 4.0).collect(), "Exchange", "shuffle records written")
    dist = np.sqrt((p.x.values[:, None] - q.x.values) ** 2 + (p.y.values[:, None] - q.y.values) ** 2)
    assert {r["a"]: (r["b"], r["distance"]) for r in got} == {k: (b, dist[k, b]) for k, b in enumerate(dist.argmin(axis=1))} and len(got) == len(p)
    assert dealt < 3 * len(p)


@pytest.mark.parametrize("limits", [{"HELD": 0}, {"CROWDED": 30, "CROWD": 50}])
def test_nearest_by_any_way(spark, monkeypatch, limits):
    """Broadcast or shuffled, in cells crowded or not: the nearest, ties to the smallest key; one row for a key of several rows."""
    for name, n in limits.items():
        monkeypatch.setattr(spatial, name, n)
    rng = np.random.default_rng(4)
    xy = np.vstack([rng.normal(6, 0.3, (100, 2)), rng.integers(-30, 30, (300, 2)), [[60.0, 9.0], [20.0, -70.0]]])
    uv = np.vstack([rng.normal(6, 0.3, (100, 2)), rng.integers(-30, 30, (400, 2)) + 0.5])
    left = pd.DataFrame({"id": [k % 400 for k in range(len(xy))], "x": xy[:, 0], "y": xy[:, 1]})
    right = pd.DataFrame({"id": rng.permutation(len(uv)), "x": uv[:, 0], "y": uv[:, 1]}).sort_values("id")
    dist = np.sqrt((left.x.values[:, None] - right.x.values) ** 2 + (left.y.values[:, None] - right.y.values) ** 2)
    dist[:2], dist[400:] = np.minimum(dist[:2], dist[400:]), np.inf
    got = spatial.nearest(spark.createDataFrame(left), spark.createDataFrame(right), ["x", "y"], 4.0).collect()
    assert {r["a"]: (r["b"], r["distance"]) for r in got} == {k: (right.id.values[b], dist[k, b]) for k, b in enumerate(dist[:400].argmin(axis=1))} and len(got) == 400


def test_salted_product_is_never_broadcast(spark, sf, tmp_path):
    """The copies of the right side are eight times what Spark takes them for; repeated entries are added up."""
    rows = [(int(i), int(k), float(v)) for i, k, v in zip(RNG.integers(0, 9, 400), RNG.integers(0, 5, 400), RNG.integers(-4, 5, 400))]
    left = Matrix(spark.createDataFrame(rows, "i long, j long, v double"), 1 << 40, 1 << 40)
    right = Matrix(spark.createDataFrame([(k, k % 2, k + 0.5) for k in range(5)], "i long, j long, v double"), 1 << 40, 64)
    want = np.zeros((9, 2))
    for i, k, v in rows:
        want[i, k % 2] += v * (k + 0.5)
    got = left.product(right, salts=8)
    assert {(r["i"], r["j"]): r["v"] for r in got.df.collect()} == {(i, j): pytest.approx(want[i, j]) for i in range(9) for j in range(2)}
    for df in (got.df, catalog.QUERIES["salted_product"](spark, sf)):
        df.write.parquet(str(tmp_path / str(id(df))))
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_overlap_at_the_rim(spark, tmp_path):
    """Balls that touch at the rim, or almost: pairs as in the SQL, whose decimal radii sum up exactly."""
    at, nation = RNG.integers(-99_999, 999_999, 400) / 100, RNG.integers(0, 25, 400)
    for table, key, shift in (("customer", "c", 0), ("supplier", "s", 80)):
        keys = np.arange(800 if shift else 400)
        rows = pd.DataFrame({f"{key}_{'supp' if shift else 'cust'}key": keys, f"{key}_acctbal": np.concatenate([at + shift, at - 70])[keys].round(2), f"{key}_nationkey": np.concatenate([nation, nation])[keys].astype("int32")})
        rows.to_parquet(tmp_path / f"{table}.parquet")
    for name in ("spatial_overlap_join", "overlap_of_wide_balls"):
        got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
        con = duckdb.connect()
        for table in ("customer", "supplier"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        want = con.execute(catalog.ORACLES[name]).df()
        assert sorted(zip(got.a, got.b)) == sorted(zip(want.a, want.b)), name
