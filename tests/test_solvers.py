import pathlib
import re

import numpy as np
import pytest

from gridloom import matrix
from gridloom.matrix import Matrix
from gridloom.operators import iterative as I
from gridloom.operators import leastsquares as L
from gridloom.operators.sparse import Triplets, combine
from gridloom.scratch import scratch_dir


def tridiagonal(spark, n, s):
    entries = [(i, j, v) for i in range(n) for j, v in ((i - 1, -s), (i, 2 * s), (i + 1, -s)) if 0 <= j < n]
    return combine(Triplets.of(spark, n, n, entries))


def values(df):
    return [r["v"] for r in df.orderBy("row").collect()]


@pytest.mark.parametrize("s", [1e-3, 1, 1e3])
def test_poisson(spark, s):
    n, x = 8, np.arange(1, 9.0)
    a = tridiagonal(spark, n, s)
    b = a.to_numpy() @ x
    options = I.SolverOptions(50, 1e-12)
    for solver in (I.cg, I.pcg):
        found, report = solver(a, b, options=options)
        assert report.converged and np.allclose(values(found), x, atol=1e-8)


def test_diagonal(spark):
    a = combine(Triplets.of(spark, 3, 3, [(0, 0, 1), (0, 0, 1), (1, 1, 4), (2, 2, 8)]))
    found, report = I.pcg(a, np.array([2, 8, 24.0]))
    assert np.allclose(values(found), [1, 2, 3]) and report.iterations == 1
    with pytest.raises(ValueError, match="row 1"):
        I.pcg(combine(Triplets.of(spark, 2, 2, [(0, 0, 1)])), np.ones(2))


def test_blocks(spark):
    blocks = np.array([[[4, 1], [1, 3]], [[2, 0.5], [0.5, 1.5]]])
    a = I.block_diagonal(spark, blocks, 4)
    x = np.array([1, -2, 3, 0.5])
    found, report = I.block_pcg(a, a.to_numpy() @ x, np.linalg.inv(blocks))
    assert np.allclose(values(found), x) and report.iterations == 1


def test_tables_and_fixed_steps(spark):
    a = tridiagonal(spark, 6, 1.0)
    x = np.arange(6.0)
    b = spark.createDataFrame([(i, float(v)) for i, v in enumerate(a.to_numpy() @ x)], "row bigint, v double")
    folder = pathlib.Path(scratch_dir(spark))
    there = set(folder.iterdir()) if folder.exists() else set()
    found, report = I.cg(a, b, options=I.SolverOptions(20, 1e-10), driver_rows=0)
    assert len(set(folder.iterdir()) - there) <= 1  # the solution's table; those of the steps are gone
    assert report.converged and np.allclose(values(found), x, atol=1e-7)
    found, report = I.cg_fixed(a, a.to_numpy() @ x, 12)
    assert report.iterations == 12 and report.converged and np.allclose(values(found), x, atol=1e-8)


def test_breakdown_and_options(spark):
    with pytest.raises(I.Breakdown):
        I.cg(combine(Triplets.of(spark, 2, 2, [(0, 0, -1), (1, 1, -1)])), np.ones(2))
    with pytest.raises(RuntimeError):
        I.cg(tridiagonal(spark, 8, 1.0), np.ones(8), options=I.SolverOptions(1, 1e-12, require_convergence=True))
    for bad in ({"relative_tolerance": 2.0}, {"absolute_tolerance": -1.0}, {"max_iterations": -1}):
        with pytest.raises(ValueError):
            I.SolverOptions(**bad)
    with pytest.raises(ValueError):
        I.cg(Matrix.zeros(spark, 2, 3), np.ones(2))


def synthetic(spark):
    rows = [
        (0, [0], 0, [[1.0, 2.0]], [0.5], [-1.0], 1.0),
        (1, [1], 0, [[-0.5, 1.0]], [1.5], [0.25], 1.0),
        (2, [0], 1, [[2.0, -1.0]], [-0.75], [2.0], 1.0),
        (3, [1], 1, [[1.25, 0.5]], [2.0], [-0.5], 1.0),
        (4, [0], None, [[0.4, -0.2]], None, [0.75], 2.0),
        (5, [], 1, [], [0.8], [-0.3], 1.5),
    ]
    return L.residual_table(spark, rows)


TIGHT = {"max_iterations": 50, "relative_tolerance": 1e-13, "absolute_tolerance": 1e-14}


@pytest.mark.parametrize("backend", ["implicit", "dense", "assembled"])
def test_schur(spark, backend):
    options = L.SchurOptions(backend, **TIGHT)
    report, p, e = L.solve_damped(L.NormalEquations.of(synthetic(spark), 2, 2, 2, 1), 0.1, options)
    expected = [-0.532196868252671, 0.717080672008074, 0.078633780070238, -0.210823022930113]
    assert report.converged and np.allclose(values(p), expected, atol=1e-11)
    assert np.allclose(values(e), [0.017900956933130, 0.253200998620430], atol=1e-11)


def test_schur_more(spark):
    options = L.SchurOptions("dense", **TIGHT)
    rows = [(0, [0, 1], 0, [[1.0], [2.0]], [3.0], [4.0], 1.0), (1, [0, 1], None, [[0.5], [-1.0]], None, [0.2], 1.0)]
    _, p, e = L.solve_damped(L.NormalEquations.of(L.residual_table(spark, rows), 2, 1, 1, 1), 0.1, options)
    assert np.allclose(values(p) + values(e), [-1.345185185185185, -0.512592592592593, -0.493827160493827], atol=1e-11)
    rows = [(0, [0], 0, [[1.0]], [1.0], [1.0], 1.0), (1, [0], 0, [[2.0]], [-1.0], [-0.5], 1.0)]
    _, p, e = L.solve_damped(L.NormalEquations.of(L.residual_table(spark, rows), 1, 1, 1, 1), 0.5)
    assert np.allclose(values(p) + values(e), [-0.069767441860465, -0.523255813953488], atol=1e-12)
    rows = [(0, [], 0, [], [2.0], [4.0], 1.0)]
    report, p, e = L.solve_damped(L.NormalEquations.of(L.residual_table(spark, rows), 0, 1, 6, 1), 0.5)
    assert report.converged and values(p) == [] and np.allclose(values(e), [-4 / 3])


def test_merge_and_workspace(spark):
    rows = synthetic(spark)
    make = lambda df: L.NormalEquations.of(df, 2, 2, 2, 1)
    whole, parts = make(rows), L.merged([make(rows.where("res < 3")), make(rows.where("res >= 3"))])
    key = lambda r: tuple(r)[:4]
    a, b = sorted(whole.sums.collect(), key=key), sorted(parts.sums.collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b] and np.allclose([r["v"] for r in a], [r["v"] for r in b])
    workspace, options = L.SchurWorkspace(), L.SchurOptions("assembled", **TIGHT)
    first, _, _ = L.solve_damped(whole, 0.1, options, workspace=workspace)
    second, _, _ = L.solve_damped(parts, 0.2, options, workspace=workspace)
    assert (first.pattern_reused, second.pattern_reused, workspace.pattern_builds) == (False, True, 1)
    with pytest.raises(ValueError):
        whole.merge(L.NormalEquations(whole.sums, 3, 2, 2, 1))


@pytest.mark.parametrize(
    "row, error",
    [
        ((0, [1], 0, [[1.0, 0.0]], [1.0], [0.0], 1.0), IndexError),
        ((0, [0], 3, [[1.0, 0.0]], [1.0], [0.0], 1.0), IndexError),
        ((0, [0], 0, [[1.0, 0.0]], [1.0], [], 1.0), ValueError),
        ((0, [0], 0, [[1.0, 0.0]], [1.0], [0.0], float("inf")), ValueError),
        ((0, [0], 0, [[1.0]], [1.0], [0.0], 1.0), ValueError),
        ((0, [0, 0], 0, [[1.0, 0.0], [1.0, 0.0]], [1.0], [0.0], 1.0), ValueError),
        ((0, [0], 0, [[float("nan"), 0.0]], [1.0], [0.0], 1.0), ValueError),
    ],
)
def test_bad_residuals(spark, row, error):
    with pytest.raises(error):
        L.NormalEquations.of(L.residual_table(spark, [row]), 1, 1, 2, 1)


def test_not_positive_definite(spark):
    rows = [(0, [0], 0, [[1.0]], [0.0], [1.0], 1.0)]
    report, p, _ = L.solve_damped(L.NormalEquations.of(L.residual_table(spark, rows), 1, 1, 1, 1), 0.0)
    assert not report.converged and report.message and p.count() == 0
    with pytest.raises(ValueError):
        L.solve_damped(L.NormalEquations.of(L.residual_table(spark, rows), 1, 1, 1, 1), -1.0)


def test_damping():
    control = L.DampingControl(1e-3, 1e-8, 1e4, 0.25, 8)
    control.accept()
    assert control.damping == 2.5e-4
    control.reject()
    assert control.damping == pytest.approx(2e-3) and (control.accepted, control.rejected) == (1, 1)
    with pytest.raises(ValueError):
        L.DampingControl(decrease=1.5)


def cameras_and_points(spark):
    """36 primary blocks of 9, 240 eliminated of 3, four observations of two residuals each, and weak priors."""
    rows = []
    for i in range(36):
        rows.append((-1 - i, [i], None, [np.eye(9).ravel().tolist()], None, [0.0] * 9, 0.25))
    for e in range(240):
        for o in range(4):
            jp = [0.01 * (1 + (k + e + o) % 13) for k in range(18)]
            je = [0.02 * (1 + (k + e + 2 * o) % 7) for k in range(6)]
            rows.append((4 * e + o, [(e * 7 + o * 5) % 36], e, [jp], je, [0.001 * (e + 1), -0.002 * (o + 1)], 1.0))
    return rows


def plain_step(rows, n, ne, dp, de, damping, least):
    h, g = np.zeros((n * dp + ne * de,) * 2), np.zeros(n * dp + ne * de)
    for _, ps, e, jps, je, r, w in rows:
        blocks = [(p * dp, np.reshape(j, (len(r), dp))) for p, j in zip(ps, jps)] + ([(n * dp + e * de, np.reshape(je, (len(r), de)))] if e is not None else [])
        for a, x in blocks:
            g[a : a + x.shape[1]] += w * x.T @ np.array(r)
            for b, y in blocks:
                h[a : a + x.shape[1], b : b + y.shape[1]] += w * x.T @ y
    d = np.diag(h).copy()
    return np.linalg.solve(h + np.diag(damping * np.maximum(np.abs(d), least)), -g)


@pytest.mark.parametrize("backend,tile", [("dense", 64), ("dense", 2), ("assembled", 3), ("implicit", 64)])
def test_schur_of_large_blocks(spark, monkeypatch, backend, tile):
    """A tile of 2 makes every eliminated id popular, so that pairs of tiles are multiplied."""
    monkeypatch.setattr(L, "TILE", tile)
    rows = cameras_and_points(spark)
    eq = L.NormalEquations.of(L.residual_table(spark, rows), 36, 240, 9, 3)
    options = L.SchurOptions(backend, 2000, 1e-13, 1e-15)
    report, p, e = L.solve_damped(eq, 0.1, options)
    assert report.converged, report.message
    assert np.allclose(values(p) + values(e), plain_step(rows, 36, 240, 9, 3, 0.1, 1e-12), atol=1e-8)
    again = L.solve_damped(eq, 0.1, options)
    assert np.allclose(values(again[1]), values(p), atol=1e-10)


def test_a_kept_pattern_saves_stages(spark, monkeypatch):
    monkeypatch.setattr(L, "TILE", 3)
    eq = L.NormalEquations.of(L.residual_table(spark, cameras_and_points(spark)), 36, 240, 9, 3)
    eq = L.NormalEquations(L.materialise(eq.table, "equations"), 36, 240, 9, 3)
    workspace, tracker = L.SchurWorkspace(), spark.sparkContext.statusTracker()
    stages = []
    for step in range(3):
        spark.sparkContext.setJobGroup(f"step{step}", "")
        report, p, _ = L.solve_damped(eq, 0.1, L.SchurOptions("dense", **TIGHT), workspace=workspace)
        stages.append(sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(f"step{step}")))
        assert report.converged and report.pattern_reused == (step > 0)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages[1] < stages[0] and stages[2] == stages[1] and workspace.pattern_builds == 1
    workspace.clear()
    assert not L.solve_damped(eq, 0.1, L.SchurOptions("dense", **TIGHT), workspace=workspace)[0].pattern_reused


def test_more_products_make_more_tasks(spark, monkeypatch):
    """Sums by block are dealt out to as many tasks as keep each small, also where two are merged."""
    rows = cameras_and_points(spark)
    few = L.NormalEquations.of(L.residual_table(spark, rows), 36, 240, 9, 3)
    monkeypatch.setattr(matrix, "TASK_ROWS", len(rows) // 4)
    halves = [L.NormalEquations.of(L.residual_table(spark, rows[k::2]), 36, 240, 9, 3) for k in range(2)]
    whole = halves[0].merge(halves[1])
    plan = whole.table._jdf.queryExecution().executedPlan().toString()
    tasks = {int(n) for n in re.findall(r"hashpartitioning\([^\n]*?, (\d+)\)", plan)}
    assert tasks == {-(-eq.most // (len(rows) // 4)) for eq in (whole, *halves)} and min(tasks) > 4
    values = lambda eq: {(r["part"], r["i"], r["j"], r["at"]): r["v"] for r in eq.sums.collect()}
    one, two = values(few), values(whole)
    assert one.keys() == two.keys() and all(np.isclose(one[k], two[k]) for k in one)
