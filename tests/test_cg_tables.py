import pathlib

import numpy as np
import pytest

from gridloom.matrix import Matrix
from gridloom.operators import cg_tables
from gridloom.operators import iterative as I
from gridloom.scratch import scratch_dir

TIGHT = I.SolverOptions(60, 1e-12)


def values(df):
    return np.array([r["v"] for r in df.orderBy("row").collect()])


def vector(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "row bigint, v double")


@pytest.fixture(scope="module")
def system(spark):
    """24 unknowns in blocks of 2, one of them coupled to all."""
    rng = np.random.default_rng(5)
    a = np.diag(rng.uniform(3, 6, 24))
    a[0, 1:] = a[1:, 0] = 0.3
    for i in range(0, 24, 2):
        a[i, i + 1] = a[i + 1, i] = 1.0
    r, c = np.nonzero(a)
    cells = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(r, c)], "row bigint, col bigint, v double")
    return a, Matrix(cells, 24, 24, sparse=True), rng.normal(size=24)


def test_against_vectors_at_the_driver(spark, system):
    a, matrix, x = system
    b = vector(spark, a @ x)
    blocks = np.linalg.inv(np.array([a[i : i + 2, i : i + 2] for i in range(0, 24, 2)]))
    begin = vector(spark, x + 0.5)
    for solver, more in ((I.cg, ()), (I.pcg, ()), (I.block_pcg, (blocks,))):
        for x0 in (None, begin):
            found, report = solver(matrix, b, *more, x0=x0, options=TIGHT, driver_rows=0)
            _, other = solver(matrix, b, *more, x0=x0, options=TIGHT)
            assert report.converged and np.allclose(values(found), x, atol=1e-9)
            assert abs(report.iterations - other.iterations) <= 1
            assert np.isclose(report.initial_residual_norm, other.initial_residual_norm)


def test_heavy_columns_are_kept_by_row(spark, system):
    a, matrix, x = system
    tables = cg_tables.Tables(spark, 4)
    operand = cg_tables.Operand(tables, matrix, heavy=10)
    assert operand.heavy == [0]
    y = operand.times(vector(spark, x).withColumnRenamed("v", "x"), cg_tables.F.col("x")).orderBy("row").collect()
    assert np.allclose([r["y"] for r in y], a @ x)
    tables.drop(*list(tables.made))
    found, told = cg_tables.solve(matrix, vector(spark, a @ x), None, None, False, TIGHT, None, heavy=10)
    assert told[0] and np.allclose(values(found), x, atol=1e-9)


def test_one_action_a_step_and_no_shuffle_of_the_matrix(spark, system, monkeypatch):
    a, matrix, x = system
    plans, write = [], cg_tables.Tables.write

    def watched(self, df, key, name):
        if name == "vectors":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, key, name)

    monkeypatch.setattr(cg_tables.Tables, "write", watched)
    _, report = I.cg(matrix, vector(spark, a @ x), options=TIGHT, driver_rows=0)
    assert len(plans) == report.iterations + 1  # one for the first residual
    assert all(p.count("Exchange hashpartitioning") == 1 and "BroadcastExchange" not in p for p in plans)  # sums by row


def test_fixed_steps_zero_residual_and_breakdown(spark, system):
    a, matrix, x = system
    found, report = I.cg_fixed(matrix, vector(spark, a @ x), 5, driver_rows=0)
    want, other = I.cg_fixed(matrix, vector(spark, a @ x), 5)
    assert report.iterations == 5 and np.allclose(values(found), values(want), atol=1e-10)
    assert np.isclose(report.final_residual_norm, other.final_residual_norm, rtol=1e-6)
    found, report = I.cg_fixed(matrix, vector(spark, np.zeros(24)), 3, preconditioned=True, driver_rows=0)
    assert report.converged and not values(found).any()
    found, report = I.cg(matrix, vector(spark, np.zeros(24)), driver_rows=0)
    assert (report.converged, report.iterations) == (True, 0) and not values(found).any()
    negative = matrix.with_values(-cg_tables.F.col("v"))
    folder = pathlib.Path(scratch_dir(spark))
    there = set(folder.iterdir())
    with pytest.raises(I.Breakdown, match="iteration 1"):
        I.cg(negative, vector(spark, a @ x), driver_rows=0)
    assert set(folder.iterdir()) == there and not spark.sql("SHOW TABLES LIKE 'gridloom*'").count()
    with pytest.raises(RuntimeError, match="no convergence"):
        I.cg(matrix, vector(spark, a @ x), options=I.SolverOptions(1, 1e-12, require_convergence=True), driver_rows=0)


def test_neighbours_are_added_up_before_the_shuffle(spark, monkeypatch):
    """Four groups of 64 linked indices: a block of columns gives one sum for each row of its group, not one for each column."""
    n, group = 256, 64
    cells = spark.range(n * group).selectExpr(f"id div {group} AS row", f"id div {group * group} * {group} + id % {group} AS col", "1.0D AS v")
    tables = cg_tables.Tables(spark, 4)
    operand = cg_tables.Operand(tables, Matrix(cells, n, n, sparse=True))
    dealt, real = [], type(cells).repartition
    monkeypatch.setattr(type(cells), "repartition", lambda self, *to: dealt.append(self.count()) or real(self, *to))
    vector = spark.range(n).selectExpr("id AS row", "CAST(id AS DOUBLE) AS x")
    got = {r["row"]: r["y"] for r in operand.times(vector, cg_tables.F.col("x")).collect()}
    tables.drop(*list(tables.made))
    assert got == {i: float(sum(range(i // group * group, i // group * group + group))) for i in range(n)}
    assert dealt == [64 * group]  # 64 blocks of four columns, 64 rows each; single columns give 256 * 64
