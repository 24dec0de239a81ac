import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.matrix import Matrix
from gridloom.operators import reduce as R

NAN, INF, MAX = math.nan, math.inf, 1.7976931348623157e308
M = np.array([1, -2, 3, -4, 5, -6.0]).reshape(3, 2).T


def values(df, column="v"):
    return [r[column] for r in df.orderBy("lane").collect()]


def same(a, b):
    return len(a) == len(b) and all(x == y or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b))


def matrix(spark, columns, rows):
    return Matrix.of(spark, np.array(columns, float).reshape(-1, rows).T)


def test_literals(spark):
    a = Matrix.of(spark, M)
    assert values(R.total(a)) == [-3] and values(R.mean(a)) == [-0.5]
    assert values(R.arg_min(a)) == [-6] and values(R.arg_min(a), "idx") == [5]
    assert values(R.arg_max(a)) == [5] and values(R.arg_max(a), "idx") == [4]
    assert values(R.total(a, R.ROWS)) == [9, -12] and values(R.mean(a, R.ROWS)) == [3, -4]
    assert values(R.arg_min(a, R.ROWS), "idx") == [0, 2] and values(R.arg_max(a, R.ROWS), "idx") == [2, 0]
    assert values(R.minimum(a, R.ROWS)) == [1, -6] and values(R.maximum(a, R.ROWS)) == [5, -2]
    assert values(R.total(a, R.COLUMNS)) == [-1] * 3 and values(R.strict_mean(a, R.COLUMNS)) == [-0.5] * 3
    assert values(R.arg_min(a, R.COLUMNS), "idx") == [1] * 3 and values(R.arg_max(a, R.COLUMNS), "idx") == [0] * 3


def test_empty(spark):
    assert values(R.total(Matrix.zeros(spark, 0, 3), R.COLUMNS)) == [0, 0, 0]
    assert values(R.total(Matrix.zeros(spark, 3, 0), R.ROWS)) == [0, 0, 0]
    assert values(R.total(Matrix.zeros(spark, 0, 0))) == [0]
    assert R.minimum(Matrix.zeros(spark, 0, 3), R.ROWS).count() == 0
    for op in (R.mean, R.strict_mean, R.minimum, R.maximum, R.arg_min, R.arg_max):
        with pytest.raises(ValueError):
            op(Matrix.zeros(spark, 0, 3), R.COLUMNS)
        with pytest.raises(ValueError):
            op(Matrix.zeros(spark, 0, 0))


def test_nan(spark):
    a = matrix(spark, [4, NAN, NAN, 2, NAN, NAN], 2)
    for axis, at in ((R.ALL, [1]), (R.ROWS, [1, 0]), (R.COLUMNS, [1, 0, 0])):
        for op in (R.arg_min, R.arg_max):
            assert values(op(a, axis), "idx") == at
            assert all(map(math.isnan, values(op(a, axis))))
        assert all(map(math.isnan, values(R.minimum(a, axis)))) and all(map(math.isnan, values(R.maximum(a, axis))))


def test_ties(spark):
    a = matrix(spark, [-5, 7, 2, -5, 7, 9, 4, 7, 9], 3)
    assert values(R.arg_min(a, R.ROWS), "idx") == [0, 0, 0] and values(R.arg_max(a, R.ROWS), "idx") == [2, 0, 1]
    assert values(R.arg_min(a, R.COLUMNS), "idx") == [0, 0, 0] and values(R.arg_max(a, R.COLUMNS), "idx") == [1, 2, 2]
    assert values(R.arg_min(a), "idx") == [0] and values(R.arg_max(a), "idx") == [5]


@pytest.mark.parametrize("row, expected", [([MAX, MAX], MAX), ([MAX, 4, -MAX], 4 / 3), ([2.0**53, 3, -(2.0**53)], 1), ([0.0, 0.0], 0)])
def test_strict_mean_extremes(spark, row, expected):
    assert values(R.strict_mean(Matrix.of(spark, [row]), R.ROWS)) == [expected]


def test_strict_mean_infinities(spark):
    rows = [[INF, 4], [-INF, -3], [INF, -INF], [NAN, 2], [1, 2]]
    assert same(values(R.strict_mean(Matrix.of(spark, rows), R.ROWS)), [INF, -INF, NAN, NAN, 1.5])


@pytest.mark.parametrize(
    "data, expected",
    [([9, 1, 2], 2), ([9, 1, 2, 4], 3), ([NAN, 7, INF, 5, 3], 5), ([NAN, INF], None), ([MAX, MAX], MAX), ([-MAX, MAX], 0)],
)
def test_finite_median(spark, data, expected):
    df = spark.createDataFrame([(float(v),) for v in data], "v double")
    assert df.agg(R.finite_median(F.col("v"))).first()[0] == expected


def test_covariance(spark):
    points = Matrix.of(spark, [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 0]])
    c = R.covariance_matrix(points).to_numpy()
    assert np.allclose(c, 0.25 * np.eye(3) - 0.0625, atol=1e-12)
    for bad in ([[1, 2, 3]], [[1, 2], [3, 4]]):
        with pytest.raises(ValueError):
            R.covariance_matrix(Matrix.of(spark, bad))


def test_dot(spark):
    make = lambda rows: spark.createDataFrame(rows, "row bigint, v double")
    x, y = make([(0, 3.0), (2, 4.0)]), make([(0, 2.0), (1, 9.0), (2, 0.5)])
    assert R.dot(x, y) == 8 and R.vector_norm(x) == 5 and R.dot(x, make([])) == 0 and R.vector_norm(make([])) == 0


@pytest.mark.parametrize("most", [3, 40, 100_000])
def test_medians_by_narrowing(spark, most):
    rng = np.random.default_rng(8)
    rows = [("many", float(x)) for x in rng.normal(size=3000) * 1e300] + [("copies", float(x)) for x in rng.integers(0, 3, 900)] + [("same", 7.0)] * 501
    rows += [("even", 1.0), ("even", 3.0), ("none", float("nan")), ("none", float("inf")), (None, -1.0), ("edge", 1.7e308), ("edge", 1.7e308), ("mixed", float("nan")), ("mixed", 2.0)]
    rows += [("skewed", float(x)) for x in 10.0 ** rng.uniform(-300, 300, 2000)]
    table = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r["g"]: r["v"] for r in R.finite_medians(table, F.col("x"), ["g"], most).collect()}
    for g in {g for g, _ in rows}:
        kept = sorted(x for h, x in rows if h == g and math.isfinite(x))
        expected = kept[(len(kept) - 1) // 2] / 2 + kept[len(kept) // 2] / 2 if kept else None
        assert got[g] == expected, g
    assert len(got) == len({g for g, _ in rows})


def test_medians_move_no_values(spark, monkeypatch):
    """No join deals values out by group, as one task would get all of a group and sort them."""
    plans = []
    real = R.materialise
    monkeypatch.setattr(R, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or real(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = spark.range(4000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
        found = R.finite_medians(table, F.col("x"), ["g"], 50)
        plans.append(found._jdf.queryExecution().toString())
        assert {r["g"]: r["v"] for r in found.collect()} == {0: 1999.0, 1: 2000.0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) > 2 and not any("SortMergeJoin" in p for p in plans)


def test_strict_mean_in_levels(spark, monkeypatch):
    """90 numbers and their opposites, of like size, and ones: what a level loses goes on to the next."""
    monkeypatch.setattr(R, "CHUNK", 4)
    x = np.random.default_rng(3).normal(size=(90, 2)) * 2.0**50
    a = Matrix.of(spark, np.vstack([x, -x, np.ones((1, 2))]))
    got = [r["v"] for r in R.strict_mean(a, R.COLUMNS).orderBy("lane").collect()]
    assert np.allclose(got, 1 / 181, rtol=1e-12)
