import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import matrix
from gridloom.matrix import Matrix
from gridloom.operators import elementwise, rows, sparse
from gridloom.operators import products as P
from gridloom.operators import sparse as S


def vector(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "row bigint, v double")


def dense(df):
    return [r["v"] for r in df.orderBy("row").collect()]


def test_combine(spark):
    r, c, v = [2, 0, 2, 1, 2, 0, 2], [4, 3, 1, 2, 1, 3, 1], [5, 2, 1e16, 4, -1e16, -2, 1]
    csr = S.compress(S.Triplets.of(spark, 4, 5, list(zip(r, c, v))))
    got = [tuple(x)[1:] for x in csr.elements.orderBy("pos").collect()]
    assert got == [(0, 3, 0.0), (1, 2, 4.0), (2, 1, 1.0), (2, 4, 5.0)]
    assert [x["offset"] for x in csr.offsets.orderBy("row").collect()] == [0, 1, 2, 4, 4]
    assert csr.nnz() == 4 and all(S.validate(csr).values())


def test_bad_triplets(spark):
    with pytest.raises(IndexError):
        S.Triplets.of(spark, 2, 2, [(2, 0, 1.0)])
    outside = spark.createDataFrame([(0, 5, 0, 1.0)], "ord bigint, row bigint, col bigint, v double")
    with pytest.raises(IndexError, match="triplet 0"):
        S.compress(S.Triplets(outside, 2, 2))
    t = S.Triplets.of(spark, 2, 2, [(0, 0, math.inf)])
    S.compress(t)
    with pytest.raises(ValueError):
        S.compress(t, require_finite=True)
    with pytest.raises(ValueError):
        S.Triplets(outside, -1, 2)


def test_append(spark):
    t = S.Triplets.of(spark, 2, 2, [(0, 0, 1e16)])
    t = t.add(spark.createDataFrame([(0, 0, 0, -1e16), (1, 0, 0, 1.0)], "ord bigint, row bigint, col bigint, v double"))
    assert t.nnz() == 3 and S.combine(t).df.first()["v"] == 1.0


def test_spmv(spark):
    a = S.combine(S.Triplets.of(spark, 3, 4, [(2, 3, 5), (0, 2, 2), (1, 1, -1), (0, 0, 3)]))
    assert dense(P.spmv(a, vector(spark, [1, 2, 3, 4]))) == [9, -2, 20]
    a = S.combine(S.Triplets.of(spark, 3, 2, [(1, 0, 2)]))
    assert dense(P.spmv(a, vector(spark, [3, 4]))) == [0, 6, 0]


def test_spmm(spark):
    a = S.combine(S.Triplets.of(spark, 3, 3, [(1, 1, 4), (0, 2, 2), (2, 0, -1), (0, 0, 3)]))
    b = Matrix.of(spark, np.array([[1, 10], [2, 20], [3, 30.0]]))
    assert P.spmm(a, b).to_numpy().T.ravel().tolist() == [9, 8, -1, 90, 80, -10]
    with pytest.raises(ValueError):
        P.spmm(a, Matrix.zeros(spark, 2, 2))


def test_band_matrix(spark):
    n, entries = 50, []
    for i in range(n):
        entries += [(i, j, v) for j, v in ((i, 4.0), (i - 1, -1.0), (i + 1, -1.0), (i - 2, -0.5), (i + 2, -0.5)) if 0 <= j < n]
    csr = S.compress(S.Triplets.of(spark, n, n, entries))
    assert csr.nnz() == 5 * n - 6
    offsets = [r["offset"] for r in csr.offsets.orderBy("row").collect()]
    assert offsets == sorted(offsets)


@pytest.mark.parametrize("shape", [(3, 4, 2), (5, 5, 5), (1, 7, 3)])
def test_gemm(spark, shape):
    rng = np.random.default_rng(42)
    x, y = rng.random((shape[0], shape[1])), rng.random((shape[1], shape[2]))
    a, b = Matrix.of(spark, x), Matrix.of(spark, y)
    assert np.allclose(P.gemm(a, b).to_numpy(), x @ y, atol=1e-12)
    assert np.allclose(P.block_gemm(a, b, size=3).to_numpy(), x @ y, atol=1e-12)
    assert np.allclose(P.gram(a).to_numpy(), x.T @ x, atol=1e-12)
    with pytest.raises(ValueError):
        P.gemm(a, Matrix.zeros(spark, shape[1] + 1, 2))


def test_gemm_without_inner(spark):
    c = P.gemm(Matrix.zeros(spark, 2, 0), Matrix.zeros(spark, 0, 3))
    assert c.to_numpy().tolist() == [[0, 0, 0]] * 2


def test_ordered_sums_stream(spark):
    import numpy as np
    import pyarrow as pa

    from gridloom.operators.sparse import _ordered_sums

    rng = np.random.default_rng(2)
    sizes = [1, 40, 3, 1000, 2, 1, 77]
    row = np.repeat(np.arange(len(sizes)), sizes)
    v = rng.normal(size=len(row)) * 10.0 ** rng.integers(-8, 17, len(row))
    expected = []
    for i in range(len(sizes)):
        total, *rest = v[row == i].tolist()
        for x in rest:
            total += x
        expected.append((i, 0, total))
    for step in (1, 7, 64, 5000):
        batches = [pa.RecordBatch.from_pydict({"row": row[a : a + step], "col": np.zeros(len(row[a : a + step]), np.int64), "v": v[a : a + step]}) for a in range(0, len(row), step)]
        got = [t for b in _ordered_sums(iter(batches)) for t in zip(*(c.to_pylist() for c in b.columns))]
        assert got == expected


def test_sparse_products_are_added_up_by_ranges_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.where(rng.uniform(size=(90, 40)) < 0.2, rng.integers(-4, 5, (90, 40)), 0).astype(float)
    x[:, 3] = rng.integers(1, 5, 90)  # a row of the product with very many terms
    r, c = np.nonzero(x)
    cells = spark.createDataFrame(list(zip(r.tolist(), c.tolist(), x[r, c].tolist())), "row bigint, col bigint, v double")
    a = Matrix(cells, 90, 40, sparse=True)
    monkeypatch.setattr(P, "PIECE", 50)
    for terms in (300, 1 << 20):  # dealt out by inner index, and not
        monkeypatch.setattr(P, "TERMS", terms)
        got = P.gram(a)
        assert np.array_equal(got.to_numpy(), x.T @ x)
        assert got.df.count() == got.df.select("row", "col").distinct().count() == np.count_nonzero((x != 0).astype(int).T @ (x != 0).astype(int))
        assert "FlatMapCoGroupsInArrow" in got.df._jdf.queryExecution().executedPlan().toString()
    none = P.gemm(Matrix(cells.limit(0), 40, 90, sparse=True), a)
    assert none.sparse and none.df.count() == 0


def test_products_of_32_bit_indices(spark):
    """Keys of a table may be int: s_suppkey and s_nationkey are."""
    left = spark.createDataFrame([(0, 1, 2.0), (2, 0, 3.0)], "row int, col bigint, v double")
    right = spark.createDataFrame([(0, 1, 5.0), (1, 0, 7.0)], "row int, col int, v double")
    c = P.gemm(Matrix(left, 3, 2, sparse=True), Matrix(right, 2, 2, sparse=True))
    assert dict(c.df.dtypes) == {"row": "int", "col": "int", "v": "double"}
    assert c.to_numpy().tolist() == [[14, 0], [0, 0], [0, 15]]


def _tasks(df):
    """The partitions into which df's plan deals rows by hash."""
    return [int(n) for n in re.findall(r"hashpartitioning\([^\n]*?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())]


def test_more_elements_make_more_tasks(spark, monkeypatch):
    """What a task groups, sorts or joins does not grow with the elements."""
    monkeypatch.setattr(matrix, "TASK_ROWS", 50)
    monkeypatch.setattr(rows, "BROADCAST_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        triplets = sparse.Triplets.of(spark, 40, 30, [(i * 7 % 40, i * 11 % 30, i) for i in range(1000)])
        idx = spark.range(20).select(F.col("id").alias("ord"), (F.col("id") * 2).alias("idx"))
        a = sparse.combine(triplets, ordered=False)
        full = a.to_numpy()
        moved = full.copy()
        moved[np.arange(20) * 2] = -full[:20]
        for got, expected in (
            (a, full),
            (sparse.combine(triplets), full),
            (elementwise.sub(a, elementwise.scalar_multiply(sparse.combine(triplets), 3.0)), -2 * full),
            (rows.scatter_rows(elementwise.scalar_multiply(a, -1.0), idx, a), moved),
        ):
            assert np.array_equal(got.to_numpy(), expected)
            assert _tasks(got.df).count(20) > 0 and all(n == 20 or n == 4 for n in _tasks(got.df))
        assert 4 not in _tasks(a.df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
