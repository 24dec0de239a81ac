import math

import numpy as np
import pytest

from gridloom.functions import kernels as K
from gridloom.operators import geometry as G
from gridloom.operators import small as S


def test_eigh3_literals():
    w, v = K.eigh3(np.array([[5, 0, 0, -2, 0, 1], [3, 0, 0, 3, 0, 3], [3, 1, 1, 3, 1, 3], [1, 2, -1, 4, -2, 1], [0] * 6], float))
    assert np.allclose(w, [[-2, 1, 5], [3, 3, 3], [2, 2, 5], [0, 0, 6], [0, 0, 0]], atol=2e-11)
    assert np.allclose(v[1], np.eye(3)) and np.allclose(v[4], np.eye(3))
    assert np.allclose(v[2][:, 0], np.array([1, -0.5, -0.5]) / math.sqrt(1.5), atol=1e-12)


def test_eigh3_invariants():
    rng = np.random.default_rng(0xE193)
    c = rng.normal(size=(500, 6)) * 10.0 ** rng.integers(-8, 8, (500, 1))
    w, v = K.eigh3(c)
    a = K.unpack_symmetric(c)
    top = np.abs(c).max(axis=1)[:, None, None]
    assert (np.diff(w, axis=1) >= 0).all()
    assert np.abs((a @ v - v * w[:, None, :]) / top).max() < 2e-13
    assert np.abs(v.transpose(0, 2, 1) @ v - np.eye(3)).max() < 2e-13
    assert np.allclose(w / top[:, 0], np.linalg.eigvalsh(a) / top[:, 0], atol=2e-13)
    largest = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None, :], axis=1)
    assert (largest >= 0).all()


def test_eigh3_extremes():
    big = 1.7976931348623157e308
    w, v = K.eigh3(np.array([[0.5 * big, 0, 0, -0.25 * big, 0, 0.1 * big], [0, 5e-324, 0, 0, 0, 0]]))
    assert np.isfinite(w).all() and np.isfinite(v).all()
    assert np.allclose(w[0] / big, [-0.25, 0.1, 0.5])


def test_svd3():
    m = np.vstack([[1, 2, -1, 0.5, 3, 2, -2, 1, 4], [0] * 9, [1, 2, 3, 2, 4, 6, 3, 6, 9], np.random.default_rng(1).normal(size=(50, 9))])
    u, s, vt = K.svd3(m)
    assert np.allclose(u @ (s[:, :, None] * vt), m.reshape(-1, 3, 3), atol=1e-9)
    assert np.allclose(u.transpose(0, 2, 1) @ u, np.eye(3), atol=1e-9) and (np.diff(s, axis=1) <= 1e-12).all()


def test_solve_small():
    a = np.array([[0, 2, 1, 1, -2, -3, 2, 3, 1], [1, 2, 3, 2, 4, 6, 1, 1, 1], [math.inf] + [1] * 8, [1e12, 0, 0, 0, 1e-3, 0, 0, 0, 4]], float)
    b = np.array([[3, 0, 7], [1, 2, 3], [1, 1, 1], [1e12, 2e-3, 12]], float)
    x, ok = K.solve_small(a.reshape(-1, 3, 3), b)
    assert ok.tolist() == [True, False, False, True]
    assert np.allclose(a[0].reshape(3, 3) @ x[0], b[0]) and np.allclose(x[3], [1, 2, 3])


def test_spd_inverse():
    a = np.array([[[4, 1], [1, 3]], [[1, 2], [2, 1]], [[np.nan, 0], [0, 1]]], float)
    inverse, ok = K.spd_inverse(a)
    assert ok.tolist() == [True, False, False] and np.allclose(inverse[0] @ a[0], np.eye(2))


def test_columns(spark):
    df = spark.createDataFrame([(0, [5.0, 0.0, 0.0, -2.0, 0.0, 1.0]), (1, [3.0, 1.0, 1.0, 3.0, 1.0, 3.0])], "id bigint, c array<double>")
    got = S.symmetric_eigh3(df, "c", "id").orderBy("id").collect()
    assert np.allclose([r["eigenvalues"] for r in got], [[-2, 1, 5], [2, 2, 5]]) and len(got[0]["eigenvectors"]) == 9
    bad = spark.createDataFrame([(0, [5.0, 0.0, 0.0, -2.0, 0.0, 1.0]), (7, [3.0, 1.0, math.nan, 3.0, 1.0, 3.0])], "id bigint, c array<double>")
    with pytest.raises(ValueError, match="row 7, column 2"):
        S.symmetric_eigh3(bad, "c", "id")
    zero = S.symmetric_eigh3(bad, "c", "id", on_error="zero").where("id = 7").first()
    assert zero["eigenvalues"] == [0, 0, 0] and zero["eigenvectors"] == [0] * 9
    solved = S.solve_small(spark.createDataFrame([([2.0, 0.0, 0.0, 4.0], [2.0, 8.0]), ([0.0] * 4, [1.0, 1.0])], "a array<double>, b array<double>"), "a", "b", 2).collect()
    assert [r["x"] for r in solved] == [[1, 2], None]


def test_geometry(spark):
    assert np.allclose(G.rotation_matrix((0, 0, 2), math.pi / 2), [[0, -1, 0], [1, 0, 0], [0, 0, 1]], atol=1e-12)
    with pytest.raises(ValueError):
        G.rotation_matrix((0, 0, 1e-13), 1)
    t = G.rigid_transform(np.eye(3), (10, 0, 0))
    assert t.tolist()[3] == [0, 0, 0, 1]
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], "x double, y double, z double")
    assert [tuple(r) for r in G.transform_points(df, t).collect()] == [(11, 2, 3), (14, 5, 6)]
    t[3] = [9, 9, 9, 9]
    assert G.transform_points(df, t).first()["x"] == 11
    with pytest.raises(ValueError):
        G.rigid_transform(np.eye(2), (0, 0, 0))
