"""Every operator on sparse matrices and on matrices in rows and columns against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.matrix import BY_COLUMNS, BY_ROWS, CELLS, Matrix
from gridloom.operators import dense, elementwise, products, reduce, rows

NAN = float("nan")


def sparse_of(spark, x):
    """The non-zero elements of x, and a stored zero."""
    cells = [(int(r), int(c), float(x[r, c])) for r, c in zip(*np.nonzero(x))] + [(x.shape[0] - 1, 0, 0.0)] * int(x[-1, 0] == 0)
    return Matrix(spark.createDataFrame(cells, "row long, col long, v double"), *x.shape, sparse=True)


def rows_of(spark, x):
    table = spark.createDataFrame([(i, line.tolist()) for i, line in enumerate(x)], "i long, a array<double>")
    return Matrix.from_arrays(table, "i", "a", *x.shape)


def kinds(spark, x):
    yield sparse_of(spark, x)
    yield Matrix.of(spark, x)
    yield rows_of(spark, x)
    yield rows_of(spark, x.T).transpose()


SPARSE = np.array([[2, 3, 0, 0, 0], [0, 0, 0, 0, 0], [0, 0, -5, 0, 0], [0, -1, -2, -3, -4], [7, 0, 0, 0, 0], [-1, -1, -1, -1, -1.0]])
RANDOM = np.where(np.random.default_rng(4).random((9, 7)) < 0.3, np.random.default_rng(5).normal(size=(9, 7)).round(2), 0)


def same(m, expected):
    assert m.shape == expected.shape and np.allclose(m.to_numpy(), expected, equal_nan=True), (m.to_numpy(), expected)


@pytest.mark.parametrize("x", [SPARSE])
def test_elementwise(spark, x):
    other = np.roll(x, 1, 0)
    for a, b in zip(kinds(spark, x), kinds(spark, other)):
        same(a, x)
        same(a.transpose(), x.T)
        same(elementwise.add(a, b), x + other)
        same(elementwise.sub(a, b), x - other)
        same(elementwise.hadamard_multiply(a, b), x * other)
        with np.errstate(all="ignore"):
            same(elementwise.hadamard_divide(a, b), x / other)
            same(elementwise.hadamard_divide(a, elementwise.absolute(a)), x / np.abs(x))
            same(elementwise.sqrt(a), np.sqrt(x))
            same(elementwise.scalar_multiply(a, NAN), x * NAN)
        same(elementwise.scalar_add(a, 1.5), x + 1.5)
        same(elementwise.scalar_multiply(a, -2), x * -2)
        same(elementwise.clamp(a, 1, 2), np.clip(x, 1, 2))
        same(elementwise.clamp(a, -1, 2), np.clip(x, -1, 2))
        same(a.fill(3), np.full(x.shape, 3.0))
        assert a.get(1, 1) == x[1, 1]
        changed = x.copy()
        changed[1, 1] = 9
        same(a.set(1, 1, 9), changed)
        same(elementwise.scalar_add(a, 1).set(1, 1, 9), np.where(changed == 9, 9, x + 1))
    for b in kinds(spark, other):
        same(elementwise.add(sparse_of(spark, x), b), x + other)
        same(elementwise.add(rows_of(spark, x), b), x + other)


def lanes(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("lane").collect()]


@pytest.mark.parametrize("bucket,every,x", [(3, True, np.where(SPARSE == -5, NAN, SPARSE)), (3, False, RANDOM), (reduce.BUCKET, False, -np.abs(SPARSE)), (4, False, np.abs(SPARSE))])
def test_reductions(spark, monkeypatch, x, bucket, every):
    monkeypatch.setattr(reduce, "BUCKET", bucket)
    views = {reduce.ALL: x.T.reshape(1, -1), reduce.ROWS: x, reduce.COLUMNS: x.T}
    for a in kinds(spark, x) if every else [sparse_of(spark, x)]:
        for axis, view in views.items():
            assert np.allclose([v for (v,) in lanes(reduce.total(a, axis), "v")], view.sum(1), equal_nan=True)
            for mean in (reduce.mean, reduce.strict_mean):
                assert np.allclose([v for (v,) in lanes(mean(a, axis), "v")], view.mean(1), equal_nan=True)
            for low, arg, f, g in ((reduce.minimum, reduce.arg_min, np.min, np.argmin), (reduce.maximum, reduce.arg_max, np.max, np.argmax)):
                assert np.allclose([v for (v,) in lanes(low(a, axis), "v")], f(view, axis=1), equal_nan=True)
                found = lanes(arg(a, axis), "v", "idx")
                assert [i for _, i in found] == g(view, axis=1).tolist(), (axis, a.layout, found)


def test_a_matrix_without_stored_elements(spark):
    a = Matrix(spark.createDataFrame([], "row long, col long, v double"), 3, 2, sparse=True)
    assert lanes(reduce.arg_max(a, reduce.ROWS), "lane", "v", "idx") == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert lanes(reduce.total(a, reduce.ALL), "v") == [(0,)] and lanes(reduce.strict_mean(a, reduce.COLUMNS), "v") == [(0,), (0,)]
    same(products.gram(a), np.zeros((2, 2)))
    same(a @ a.transpose(), np.zeros((3, 3)))


@pytest.mark.parametrize("x", [RANDOM])
def test_products(spark, x):
    for a in kinds(spark, x):
        same(products.gram(a), x.T @ x)
        for b in kinds(spark, x.T.copy()):
            c = a @ b
            same(c, x @ x.T)
            same(elementwise.add(c, Matrix.of(spark, np.ones(c.shape))), x @ x.T + 1)
            assert lanes(reduce.mean(c), "v")[0][0] == pytest.approx((x @ x.T).mean())
        same(elementwise.scalar_add(a, 1) @ elementwise.scalar_add(a, 2).transpose(), (x + 1) @ (x + 2).T)
        same(elementwise.scalar_add(a, 1).transpose() @ elementwise.scalar_add(a, 2), (x + 1).T @ (x + 2))
    c = (sparse_of(spark, x) @ sparse_of(spark, x.T)).set(1, 1, 4.0)
    assert c.get(1, 1) == 4 and c.sparse


@pytest.mark.parametrize("shape", [(5, 7, 3), (1, 20, 1)])
def test_tiles(spark, monkeypatch, shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    x, y = rng.normal(size=(m, k)), rng.normal(size=(k, n))
    monkeypatch.setattr(products, "SMALL", 0)
    for a in kinds(spark, x):
        for b in kinds(spark, y):
            same(products.block_gemm(a, b, size=3, depth=4), x @ y)
            same(a @ b, x @ y)
    same(products.block_gemm(rows_of(spark, x), rows_of(spark, y), size=50), x @ y)


def test_rows(spark):
    idx = spark.createDataFrame([(0, 4), (1, 0), (2, 4)], "ord long, idx long")
    mask = spark.createDataFrame([(i, i % 2) for i in range(6)], "row long, keep int")
    counts = SPARSE.astype(int)
    for a in kinds(spark, SPARSE):
        same(rows.gather_rows(a, idx, 3), SPARSE[[4, 0, 4]])
        kept, _ = rows.compact_rows(a, mask)
        same(kept, SPARSE[1::2])
        same(rows.exclusive_scan(a.with_values(F.col("v").cast("long"))), (np.cumsum(counts.T.ravel()) - counts.T.ravel()).reshape(5, 6).T)
        for out in kinds(spark, RANDOM[:6, :5]):
            expected = RANDOM[:6, :5].copy()
            expected[4], expected[0] = SPARSE[0], SPARSE[1]
            same(rows.scatter_rows(rows.gather_rows(a, spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "ord long, idx long"), 3), idx, out), expected)
    table = spark.createDataFrame([(5, 1, "x", 2), (7, 0, "y", 3)], "n long, one int, bucket string, before int")
    (row,) = rows.compact(table, "n", F.col("one") == 1).collect()
    assert row.asDict() == {"n": 5, "one": 1, "bucket": "x", "before": 2, "new_row": 0}


def test_decompositions_of_sparse(spark):
    x = np.where(np.random.default_rng(1).random((30, 4)) < 0.2, 1.5, 0)
    x[:, 0] += np.arange(30) % 3 == 0
    for limit in (0, 10**6):
        f = dense.svd(sparse_of(spark, x), driver_elements=limit)
        assert np.allclose(f.values, np.linalg.svd(x, compute_uv=False))
        q, r = dense.qr(sparse_of(spark, x), driver_elements=limit)
        same(q @ r, x)


def test_layouts(spark):
    x = np.arange(6.0).reshape(2, 3)
    a = rows_of(spark, x)
    assert (a.layout, a.transpose().layout, a.df.columns) == (BY_ROWS, BY_COLUMNS, ["row", "col", "v"])
    assert Matrix.of(spark, x).by_rows().layout == BY_ROWS and elementwise.add(a, a).source is a.source
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    twice = elementwise.hadamard_multiply(elementwise.scalar_add(a, 1), elementwise.sqrt(a))
    assert "Exchange" not in plan(twice.df) and "Join" not in plan(twice.df)
    assert "Exchange" not in plan(reduce.arg_max(a, reduce.ROWS))
    assert Matrix.of(spark, x).layout == CELLS
    with pytest.raises(ValueError):
        Matrix(a.source, 2, 3, sparse=True, layout=BY_ROWS)
