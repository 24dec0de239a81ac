import numpy as np
import pyarrow as pa
import pytest

from gridloom.matrix import Matrix
from gridloom.operators import definite, dense, iterative
from gridloom.operators import leastsquares as L
from gridloom.plans import catalogue


def bordered(groups=3, each=4, hubs=2, size=2, seed=1):
    """A positive definite matrix of groups of blocks that only hubs link, in mixed order."""
    rng = np.random.default_rng(seed)
    count = groups * each + hubs
    keep = np.kron(np.eye(groups), np.ones((each, each)))
    keep = np.block([[keep, np.ones((groups * each, hubs))], [np.ones((hubs, groups * each)), np.ones((hubs, hubs))]])
    a = rng.normal(size=(count * size,) * 2) * np.kron(keep, np.ones((size, size)))
    a = a + a.T + 4 * count * np.eye(count * size)
    mixed = (rng.permutation(count)[:, None] * size + np.arange(size)).ravel()
    return a[np.ix_(mixed, mixed)], count


def blocks_of(spark, a, size, lower=True):
    count = len(a) // size
    tiles = a.reshape(count, size, count, size).transpose(0, 2, 1, 3)
    i, j = np.nonzero(np.abs(tiles).sum((2, 3)))
    i, j = (i[i >= j], j[i >= j]) if lower else (i, j)
    return spark.createDataFrame(pa.table({"i": i, "j": j, "values": tiles[i, j].reshape(len(i), -1).tolist()}))


@pytest.mark.parametrize("hubs", [0, 2])
@pytest.mark.parametrize("strip", [3, 256])
def test_components_and_a_border(spark, monkeypatch, hubs, strip):
    monkeypatch.setattr(definite, "SIDE", 10)
    monkeypatch.setattr(definite, "STRIP", strip)
    a, count = bordered(hubs=hubs)
    b = np.arange(len(a)) - 3.0
    x = definite.solve_definite(blocks_of(spark, a, 2), count, 2, b)
    assert np.allclose(x, np.linalg.solve(a, b), rtol=1e-10, atol=1e-12)


def test_a_component_that_is_too_large_is_left(spark, monkeypatch):
    monkeypatch.setattr(definite, "SIDE", 5)
    a, count = bordered(hubs=0)
    assert definite.solve_definite(blocks_of(spark, a, 2), count, 2, np.ones(len(a))) is None


@pytest.mark.parametrize("side", [10, 5])  # by components, in panels
@pytest.mark.parametrize("where", ["component", "border"])
def test_an_indefinite_system_is_no_step(spark, monkeypatch, side, where):
    """Elimination solves it, but it has no Cholesky factor: the report must tell, as it does of a small one."""
    monkeypatch.setattr(definite, "SIDE", side)
    monkeypatch.setattr(L, "DRIVER_ELEMENTS", 10)
    a, count = bordered()
    hub = int(np.argmax(np.count_nonzero(a, axis=1))) // 2
    at = 2 * hub if where == "border" else 2 * ((hub + 1) % count)
    good = a.copy()
    a[at, at] = -50.0
    space = iterative.DriverVectors(spark, len(a))
    for full, ok in ((a, False), (good, True)):
        blocks = blocks_of(spark, full, 2, lower=False)
        s = L._cells(blocks, 2, 2, *full.shape)
        small = len(full) ** 2 * 2
        monkeypatch.setattr(dense.solve, "__defaults__", (0 if side == 5 else small, False))
        x, report = L._dense(s, space, np.ones(len(full)), L.SchurOptions("dense"), blocks, 2)
        assert report.converged == ok and (ok or "positive definite" in report.message)
        assert not ok or np.allclose(full @ x, 1)


def test_panels_of_a_definite_matrix(spark):
    a, _ = bordered(hubs=0)
    b = np.arange(len(a), dtype=float)[:, None]
    x = dense.solve(Matrix.of(spark, a), Matrix.of(spark, b), driver_elements=100, definite=True)
    assert np.allclose(x.to_numpy(), np.linalg.solve(a, b))
    with pytest.raises(dense.Singular, match="definite"):
        dense.solve(Matrix.of(spark, -a), Matrix.of(spark, b), driver_elements=100, definite=True)


def test_a_system_that_is_too_large_raises(spark, monkeypatch):
    """It was told by the report, as if the matrix were singular, and the step was empty."""
    monkeypatch.setattr(L, "DRIVER_ELEMENTS", 10)
    monkeypatch.setattr(dense, "DRIVER_ELEMENTS", 10)
    monkeypatch.setattr(definite, "SIDE", 5)
    monkeypatch.setattr(dense.solve, "__defaults__", (10, False))
    a, _ = bordered(hubs=0)
    blocks = blocks_of(spark, a, 2, lower=False)
    with pytest.raises(ValueError, match="too many"):
        L._dense(L._cells(blocks, 2, 2, *a.shape), iterative.DriverVectors(spark, len(a)), np.ones(len(a)), L.SchurOptions("dense"), blocks, 2)


@pytest.mark.parametrize("name", ["lm_fit", "schur_step_dense"])
def test_a_failed_step_is_no_result(spark, monkeypatch, name):
    empty = spark.createDataFrame([], "row bigint, v double")
    failed = L.SchurReport("dense", False, 0, 0.0, 0.0, message="no factor")
    monkeypatch.setattr(L, "solve_damped", lambda *_: (failed, empty, empty))
    with pytest.raises(RuntimeError, match="no factor"):
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
