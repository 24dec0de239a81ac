import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.matrix import Matrix
from gridloom.operators import elementwise as E

A = np.array([-2, -0.5, 0, 1, 2, 4]).reshape(3, 2).T
B = np.array([1, 2, -4, 0.5, -2, 8]).reshape(3, 2).T


def listed(m):
    return m.to_numpy().T.ravel().tolist()


def test_literals(spark):
    a, b = Matrix.of(spark, A), Matrix.of(spark, B)
    assert listed(E.scalar_multiply(a, 2)) == [-4, -1, 0, 2, 4, 8]
    assert listed(E.scalar_add(a, -1)) == [-3, -1.5, -1, 0, 1, 3]
    assert listed(E.scalar_divide(a, 2)) == [-1, -0.25, 0, 0.5, 1, 2]
    assert listed(E.hadamard_multiply(a, b)) == [-2, -1, 0, 0.5, -4, 32]
    assert listed(E.hadamard_divide(a, b)) == [-2, -0.25, 0, 2, -1, 0.5]
    assert listed(E.clamp(a, -1, 1)) == [-1, -0.5, 0, 1, 1, 1]
    assert listed(E.add(a, b)) == (A + B).T.ravel().tolist()
    assert listed(E.sub(a, b)) == (A - B).T.ravel().tolist()
    assert listed(E.absolute(a)) == [2, 0.5, 0, 1, 2, 4]
    root = listed(E.sqrt(a))
    assert math.isnan(root[0]) and math.isnan(root[1]) and root[2:] == [0, 1, math.sqrt(2), 2]
    assert np.array_equal(a.transpose().to_numpy(), A.T)


def test_operators(spark):
    a, b = Matrix.of(spark, A), Matrix.of(spark, B)
    assert listed(2 * a) == listed(a * 2) == [-4, -1, 0, 2, 4, 8]
    assert listed(1 + a) == listed(a + 1) == [-1, 0.5, 1, 2, 3, 5]
    assert listed(a + b) == (A + B).T.ravel().tolist() and listed(a - b) == (A - B).T.ravel().tolist()
    assert np.allclose((a @ b.transpose()).to_numpy(), A @ B.T)


def test_errors(spark):
    a = Matrix.of(spark, A)
    with pytest.raises(ValueError):
        E.add(a, a.transpose())
    for zero in (0.0, -0.0):
        with pytest.raises(ZeroDivisionError):
            E.scalar_divide(a, zero)
    with pytest.raises(ValueError):
        E.clamp(a, 1, -1)
    with pytest.raises(IndexError):
        a.get(2, 0)
    with pytest.raises(ValueError):
        Matrix.zeros(spark, -1, 2)


def test_elements(spark):
    a = Matrix.of(spark, A)
    assert a.get(1, 2) == 4
    assert a.set(1, 2, 7.5).get(1, 2) == 7.5
    assert listed(Matrix.zeros(spark, 2, 3)) == [0] * 6
    assert listed(a.fill(3)) == [3] * 6
    assert Matrix.zeros(spark, 0, 3).df.count() == 0 and Matrix.zeros(spark, 0, 3).shape == (0, 3)


def test_ieee_division(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, -0.0), (math.nan, 0.0), (1.0, math.nan), (math.inf, 2.0), (3.0, 2.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "n double, d double").select(C.ieee_divide(F.col("n"), F.col("d"))).collect()]
    with np.errstate(all="ignore"):
        expected = [float(np.float64(n) / np.float64(d)) for n, d in rows]
    assert all(g == e or math.isnan(g) and math.isnan(e) for g, e in zip(got, expected))


def test_clamp_keeps_nan(spark):
    got = [r[0] for r in spark.createDataFrame([(math.nan,), (-math.inf,), (5.0,)], "v double").select(C.clamp(F.col("v"), -1, 1)).collect()]
    assert math.isnan(got[0]) and got[1:] == [-1, 1]


def test_vectors(spark):
    one = spark.range(1)
    a, b = C.vec(1.0, 2.0, 3.0), C.vec(4.0, -1.0, 2.0)

    def value(c):
        found = one.select(c.alias("c")).first()["c"]
        return tuple(found) if hasattr(found, "_fields") or isinstance(found, tuple) else found

    assert value(C.vec_add(a, b)) == (5, 1, 5)
    assert value(C.vec_sub(a, b)) == (-3, 3, 1)
    assert value(C.vec_scale(a, F.lit(2.0))) == (2, 4, 6)
    assert value(C.vec_divide(a, F.lit(2.0))) == (0.5, 1, 1.5)
    assert value(C.dot(a, b)) == 8
    assert value(C.cross(a, b)) == (7, 10, -9)
    assert value(C.norm(C.vec(2.0, 3.0, 6.0))) == 7
    assert value(C.normalized(C.vec(0.0, 3.0, 4.0))) == (0, 0.6, 0.8)
    assert value(C.normalized(C.vec(1e-17, 0.0, 0.0))) == (1e-17, 0, 0)
    assert value(C.vec_finite(C.vec(1.0, math.inf, 0.0))) is False
    assert value(C.vec_to_array(C.vec_of_array(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))) == [1, 2, 3]


def test_huber(spark):
    def both(s, delta):
        return tuple(spark.createDataFrame([(s,)], "s double").select(*C.huber(F.col("s"), delta)).first())

    assert both(4.0, 3.0) == (2, 1)
    assert both(25.0, 3.0) == pytest.approx((10.5, 0.6))
    assert both(25.0, 0.0) == (12.5, 1)
    with pytest.raises(ValueError):
        C.huber(F.lit(1.0), -1.0)
    with pytest.raises(Exception, match="negative"):
        both(-1.0, 3.0)
    for odd in (float("nan"), float("inf"), -1.0):
        with pytest.raises(Exception, match="finite"):
            spark.createDataFrame([(odd,)], "s double").select(*C.huber(F.col("s"), 1.0)).first()
    for delta in (float("nan"), float("inf")):
        with pytest.raises(ValueError):
            C.huber(F.lit(1.0), delta)


def test_sparse_matrices(spark):
    stored = lambda rows: Matrix(spark.createDataFrame(rows, "row long, col long, v double"), 3, 3, sparse=True)
    a, b = stored([(0, 1, 2.0), (2, 2, float("nan"))]), stored([(0, 1, 5.0), (1, 0, 7.0)])
    assert a.get(0, 1) == 2.0 and a.get(1, 1) == 0.0
    changed = a.set(1, 1, 4.0).set(0, 1, 9.0)
    assert changed.get(1, 1) == 4.0 and changed.get(0, 1) == 9.0 and changed.df.count() == 3
    total = {(r["row"], r["col"]): r["v"] for r in (a + b).df.collect()}
    assert total[0, 1] == 7.0 and total[1, 0] == 7.0 and np.isnan(total[2, 2]) and len(total) == 3
    assert (b - a).transpose().get(0, 1) == 7.0 and (a + Matrix.filled(spark, 3, 3, 1.0)).df.count() == 9


def test_a_null_divisor_gives_null(spark):
    made = spark.sql("SELECT CAST(1 AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS d").select(C.ieee_divide(F.col("n"), F.col("d")).alias("v"))
    assert made.first()["v"] is None
