import numpy as np
import pytest

from gridloom.matrix import Matrix
from gridloom.operators import rows as W

BIG, LOW = 2**63 - 1, -(2**63)


def longs(spark, columns, n):
    return Matrix.of(spark, np.array(columns, np.int64).reshape(-1, n).T)


def lin(m):
    return [r["v"] for r in sorted(m.df.collect(), key=lambda r: (r["col"], r["row"]))]


def index(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "ord bigint, idx bigint")


def test_scan(spark):
    assert lin(W.exclusive_scan(longs(spark, [2, -1, 3, 4, -2, 1], 2))) == [0, 2, 1, 4, 8, 6]
    assert lin(W.exclusive_scan(longs(spark, [BIG, 0], 2))) == [0, BIG]
    assert lin(W.exclusive_scan(longs(spark, [LOW, 0], 2))) == [0, LOW]
    for bad in ([BIG, 1], [LOW, -1]):
        with pytest.raises(OverflowError):
            W.exclusive_scan(longs(spark, bad, 2))
    with pytest.raises(OverflowError):  # a prefix overflows though the total does not
        W.exclusive_scan(longs(spark, [BIG, 1, -5], 3))


def test_scan_over_buckets(spark):
    data = np.random.default_rng(3).integers(-9, 9, 50)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(data)], "at bigint, v bigint")
    got = {r["at"]: int(r["s"]) for r in W.running_sum(df, "at", "v", "s", bucket=7).collect()}
    assert [got[i] for i in range(50)] == np.cumsum(data).tolist()


def test_gather(spark):
    a = Matrix.of(spark, np.array([[10, 20, 30], [11, 21, 31], [12, 22, 32], [13, 23, 33.0]]))
    assert lin(W.gather_rows(a, index(spark, [2, 0, 2]), 3)) == [12, 10, 12, 22, 20, 22, 32, 30, 32]
    for bad in (-1, 4):
        with pytest.raises(IndexError):
            W.gather_rows(a, index(spark, [0, bad]), 2)


def test_scatter(spark):
    values = Matrix.of(spark, np.array([[100, 200], [110, 210], [120, 220.0]]))
    out = Matrix.of(spark, np.arange(1, 9.0).reshape(2, 4).T)
    assert lin(W.scatter_rows(values, index(spark, [2, 0, 2]), out)) == [110, 2, 100, 4, 210, 6, 200, 8]
    with pytest.raises(IndexError):
        W.scatter_rows(values, index(spark, [0, 4, 1]), out)
    nan = Matrix.of(spark, np.array([[np.nan, 1.0]]))
    assert np.isnan(lin(W.scatter_rows(nan, index(spark, [1]), out))[1])


def test_compact(spark):
    a = Matrix.of(spark, np.array([[10, 11, 12, 13, 14], [20, 21, 22, 23, 24.0]]).T)
    mask = spark.createDataFrame(list(enumerate([0, 2, 0, 255, 1])), "row bigint, keep smallint")
    kept, source = W.compact_rows(a, mask)
    assert kept.to_numpy().tolist() == [[11, 21], [13, 23], [14, 24]]
    assert [r["source_row"] for r in source.orderBy("row").collect()] == [1, 3, 4]
