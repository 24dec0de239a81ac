import numpy as np
import pytest

from gridloom.matrix import Matrix
from gridloom.operators import dense


@pytest.mark.parametrize("n, width", [(1, 1), (2, 2), (9, 1), (17, 3), (40, 8), (41, 40)])
def test_band_to_three_diagonals(spark, n, width):
    rng = np.random.default_rng(n)
    full = np.zeros((n, n))
    band = np.zeros((width + 1, n))
    for d in range(min(width, n - 1) + 1):
        band[d, : n - d] = rng.normal(size=n - d)
        full += np.diag(band[d, : n - d], -d) + (np.diag(band[d, : n - d], d) if d else 0)
    diagonal, beside = dense._tridiagonal(band, width)
    made = np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1)
    assert np.allclose(np.linalg.eigvalsh(made), np.linalg.eigvalsh(full), atol=1e-12)


def test_beyond_the_driver(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 30))
    for elements in (0, 130, 400):
        got = dense.eigh(Matrix.of(spark, x), driver_elements=elements)
        assert np.allclose(got, np.linalg.eigvalsh((x + x.T) / 2)[::-1], atol=1e-11)


def test_equal_eigenvalues_and_zeros(spark):
    x = np.eye(12) * 3
    x[0, 0] = -1
    assert np.allclose(dense.eigh(Matrix.of(spark, x), driver_elements=60), [3.0] * 11 + [-1.0])
    assert not dense.eigh(Matrix.zeros(spark, 8, 8), driver_elements=16).any()
    low = np.outer(np.arange(10.0), np.arange(10.0))
    assert np.allclose(dense.eigh(Matrix.of(spark, low), driver_elements=30), np.linalg.eigvalsh(low)[::-1], atol=1e-11)
    with pytest.raises(ValueError):
        dense.eigh(Matrix.zeros(spark, 2, 3))


def test_closed_form_of_a_grid(spark):
    n = 8
    line = 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    grid = np.kron(line, np.eye(n)) + np.kron(np.eye(n), line)
    one = 2 - 2 * np.cos(np.arange(1, n + 1) * np.pi / (n + 1))
    got = dense.eigh(Matrix.of(spark, grid), driver_elements=1000)
    assert np.allclose(got, np.sort((one[:, None] + one).ravel())[::-1], atol=1e-11)


@pytest.mark.parametrize("n, w", [(1, 1), (3, 2), (5, 4), (40, 7), (130, 30), (77, 1), (700, 2)])
def test_a_band_becomes_three_diagonals(n, w):
    rng = np.random.default_rng(n)
    band, full = np.zeros((w + 1, n)), np.zeros((n, n))
    for d in range(min(w + 1, n)):
        band[d, : n - d] = rng.normal(size=n - d)
        full += np.diag(band[d, : n - d], -d) + (np.diag(band[d, : n - d], d) if d else 0)
    a, b = dense._tridiagonal(band, w)
    assert np.allclose(np.linalg.eigvalsh(np.diag(a) + np.diag(b, 1) + np.diag(b, -1)), np.linalg.eigvalsh(full), atol=1e-11)


def test_sparse_matrices_near_the_diagonal_are_not_filled(spark, monkeypatch):
    """Rings and grids in a mixed order, not symmetric, with rows apart: no full matrix is written."""
    monkeypatch.setattr(dense, "materialise", lambda df, name: pytest.fail("written"))
    n, rng = 90, np.random.default_rng(4)
    full = np.zeros((n, n))
    for i in range(60):
        for step in (1, 7):
            full[i, (i + step) % 60] += rng.normal()
    for i in range(60, 80):
        full[i, i - 1 if i > 60 else i] = 1.0
    full[85, 85] = -3.0
    mixed = rng.permutation(n)
    full = full[np.ix_(mixed, mixed)]
    r, c = np.nonzero(full)
    cells = spark.createDataFrame(list(zip(r.tolist(), c.tolist(), full[r, c].tolist())), "row bigint, col bigint, v double")
    got = dense.eigh(Matrix(cells, n, n, sparse=True), driver_elements=300)
    assert np.allclose(got, np.linalg.eigvalsh((full + full.T) / 2)[::-1], atol=1e-11)


def test_wide_sparse_matrices_go_through_panels(spark):
    rng = np.random.default_rng(5)
    full = rng.normal(size=(150, 150))
    cells = Matrix.of(spark, full).df
    got = dense.eigh(Matrix(cells, 150, 150, sparse=True), driver_elements=6000)
    assert np.allclose(got, np.linalg.eigvalsh((full + full.T) / 2)[::-1], atol=1e-10)
