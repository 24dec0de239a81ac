import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import matrix
from gridloom.matrix import Matrix
from gridloom.operators import elementwise, rows


def scattered(spark, shape, kind, seed=3):
    rng = np.random.default_rng(seed)
    full = np.where(rng.random(shape) < 0.2, rng.integers(-9, 10, shape), 0)
    full[2, :] = 0
    full[:, 3] = 0
    r, c = np.nonzero(full)
    cells = spark.createDataFrame(list(zip(r.tolist(), c.tolist(), full[r, c].tolist())), "row bigint, col bigint, v bigint")
    return full, Matrix(cells.withColumn("v", F.col("v").cast(kind)), *shape, sparse=True)


@pytest.mark.parametrize("shape", [(40, 7), (6, 50)])
@pytest.mark.parametrize("kind", ["double", "bigint"])
def test_completion_shuffles_stored_elements_only(spark, shape, kind):
    full, a = scattered(spark, shape, kind)
    made = a.dense()
    assert np.array_equal(made.to_numpy(), full) and made.df.count() == full.size
    assert dict(made.df.dtypes) == {"row": "bigint", "col": "bigint", "v": kind}
    plan = made.df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert np.array_equal(elementwise.scalar_add(a, 0.5).to_numpy(), full + 0.5)


def test_scan_of_a_sparse_matrix(spark):
    full, a = scattered(spark, (40, 7), "bigint")
    lin = full.T.ravel()
    want = (np.cumsum(lin) - lin).reshape(7, 40).T
    found = rows.exclusive_scan(a)
    assert np.array_equal(found.to_numpy(), want) and found.df.count() == want.size
    assert "Window" not in found.df._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    empty = Matrix(a.df.where("false"), 4, 3, sparse=True)
    assert not rows.exclusive_scan(empty).to_numpy().any() and rows.exclusive_scan(empty).df.count() == 12
    big = Matrix(spark.createDataFrame([(1, 0, 2**62), (0, 2, 2**62)], "row bigint, col bigint, v bigint"), 3, 3, sparse=True)
    with pytest.raises(OverflowError, match="up to 6 "):
        rows.exclusive_scan(big)


def test_lanes_of_many_batches(spark, monkeypatch):
    monkeypatch.setattr(matrix, "PIECE", 10)
    import pyarrow as pa

    lane, at = np.repeat(np.arange(5), 4), np.tile([-1, 0, 2, 5], 5)
    v = np.arange(20.0)
    pieces = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 3]) for x in (lane, at, v)], ["lane", "at", "v"]) for i in range(0, 20, 3)]
    for forward in (False, True):
        made = list(matrix._lanes(pieces, 6, np.dtype(float), forward))
        got = np.concatenate([b.column("values").flatten().to_numpy() for b in made]).reshape(5, 6)
        for k in range(5):
            x = v[4 * k : 4 * k + 4]
            want = [x[0], x[1], x[1], x[2], x[2], x[2]] if forward else [x[1], 0, x[2], 0, 0, x[3]]
            assert got[k].tolist() == want
