import numpy as np
import pytest

from gridloom.matrix import Matrix
from gridloom.operators import dense


def scattered(spark, full):
    r, c = np.nonzero(full)
    return Matrix(spark.createDataFrame(list(zip(r.tolist(), c.tolist(), full[r, c].tolist())), "row bigint, col bigint, v double"), *full.shape, sparse=True)


def apart(sizes, seed=5):
    """Components of these sizes, their rows and columns mixed."""
    rng = np.random.default_rng(seed)
    n = sum(sizes)
    full, at = np.zeros((n, n)), 0
    for m in sizes:
        full[at : at + m, at : at + m] = rng.normal(size=(m, m))
        at += m
    mixed = rng.permutation(n)
    return full[np.ix_(mixed, mixed)]


def test_components_are_solved_apart(spark, monkeypatch):
    full = apart([1, 1, 3, 9, 30, 6])
    right = np.random.default_rng(1).normal(size=(50, 2))
    written = []
    real = dense.materialise
    monkeypatch.setattr(dense, "materialise", lambda df, name: written.append(name) or real(df, name))
    x = dense.solve(scattered(spark, full), Matrix.of(spark, right), driver_elements=200).to_numpy()
    assert np.allclose(full @ x, right)
    assert 0 < written.count("pivot-rows") <= 5  # only for the one of 30
    written.clear()
    x = dense.solve(scattered(spark, full), Matrix.of(spark, right), driver_elements=1000).to_numpy()
    assert np.allclose(full @ x, right) and not written


@pytest.mark.parametrize("empty", [False, True])
def test_a_singular_component_is_told(spark, empty):
    full = apart([4, 5, 6])
    full[3] = 0 if empty else full[3]
    if not empty:
        own = np.flatnonzero(full[0])
        full[own[1]] = full[own[0]]
    with pytest.raises(ValueError, match="singular"):
        dense.solve(scattered(spark, full), Matrix.of(spark, np.ones((15, 1))), driver_elements=100)


def test_components_of_long_chains():
    of = np.arange(5000)
    order = np.random.default_rng(2).permutation(4999)
    order = order[order % 1000 != 999]
    dense._joined(of, order, order + 1)
    assert np.array_equal(of, np.arange(5000) // 1000 * 1000)


def linked(parts, hubs, seed=3):
    """Indices that share elements with a few hubs only, and hubs that come together through them."""
    rng = np.random.default_rng(seed)
    n = parts + hubs
    full = np.diag(rng.uniform(3, 5, n) * rng.choice([-1, 1], n))
    for i in range(parts):
        for j in rng.choice(hubs, 3, replace=False):
            full[i, parts + j], full[parts + j, i] = rng.normal(size=2) / 3
    mixed = rng.permutation(n)
    return full[np.ix_(mixed, mixed)]


@pytest.mark.parametrize("extra", [1, 3])
def test_indices_apart_go_before_panels(spark, monkeypatch, extra):
    full = linked(150, 12)
    right = np.random.default_rng(1).normal(size=(162, extra))
    written = []
    real = dense.materialise
    monkeypatch.setattr(dense, "materialise", lambda df, name: written.append(name) or real(df, name))
    for b in (Matrix.of(spark, right), scattered(spark, right)):
        x = dense.solve(scattered(spark, full), b, driver_elements=300)
        assert x.df.count() == x.size
        assert np.allclose(x.to_numpy(), np.linalg.solve(full, right), rtol=1e-9, atol=1e-9)
    assert "pivot-rows" not in written and "leaves" in written


def test_systems_of_vectors_beyond_the_driver_are_solved(spark, monkeypatch):
    """No array of all unknowns is made, as far as indices apart are many."""
    for name in ("DRIVER_ELEMENTS", "BROADCAST_ROWS"):
        monkeypatch.setattr(dense, name, 100)
    full = linked(150, 12, seed=4)
    right = np.zeros((162, 1))
    right[7] = 1.0
    x = dense.solve(scattered(spark, full), scattered(spark, right), driver_elements=300).to_numpy()
    assert np.allclose(x, np.linalg.solve(full, right), rtol=1e-9, atol=1e-9)


def test_indices_apart_with_small_diagonals_stay(spark):
    """Zeros and small numbers on the diagonal are no pivots."""
    full = linked(90, 10, seed=6)
    weak = np.flatnonzero(np.count_nonzero(full, axis=1) == 4)[:8]
    full[weak[:4], weak[:4]] = 0
    full[weak[4:], weak[4:]] = 1e-9
    full += np.eye(100, k=1) * (np.arange(100)[:, None] % 2)
    right = np.ones((100, 1))
    x = dense.solve(scattered(spark, full), Matrix.of(spark, right), driver_elements=300).to_numpy()
    assert np.allclose(full @ x, right, atol=1e-8)


@pytest.mark.parametrize("gone", ["row", "column"])
def test_a_singular_system_of_indices_apart_is_told(spark, gone):
    full = linked(60, 8)
    full[(5,) if gone == "row" else (slice(None), 5)] = 0
    with pytest.raises(ValueError, match="singular"):
        dense.solve(scattered(spark, full), Matrix.of(spark, np.ones((68, 1))), driver_elements=100)
