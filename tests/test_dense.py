import numpy as np
import pytest

from gridloom.matrix import Matrix
from gridloom.operators import dense as D
from gridloom.sources import matrix_file


def rebuilt(f):
    u, vt = f.left.to_numpy(), f.right.to_numpy()
    k = len(f.values)
    return u[:, :k] @ np.diag(f.values) @ vt[:k]


@pytest.mark.parametrize("x", [[[4, 1, 2], [2, 3, 1], [1, 2, 4]], [[-2.5]], np.arange(8.0).reshape(4, 2), np.arange(8.0).reshape(2, 4), np.zeros((3, 3))])
def test_svd(spark, x):
    x = np.array(x, float)
    f = D.svd(Matrix.of(spark, x))
    assert np.allclose(rebuilt(f), x, atol=1e-9) and (np.diff(f.values) <= 0).all()
    u = f.left.to_numpy()
    assert u.shape == (len(x), len(x)) and np.allclose(u.T @ u, np.eye(len(x)), atol=1e-9)


def test_tall(spark):
    x = np.random.default_rng(7).normal(size=(80, 6))
    a = Matrix.of(spark, x)
    assert np.allclose(rebuilt(D.svd(a, driver_elements=0)), x, atol=1e-9)
    q, r = D.qr(a, driver_elements=0, full=False)
    q, r = q.to_numpy(), r.to_numpy()
    assert np.allclose(q @ r, x, atol=1e-9) and np.allclose(q.T @ q, np.eye(6), atol=1e-9) and not np.tril(r, -1).any()


@pytest.mark.parametrize("full", [True, False])
@pytest.mark.parametrize("kind", ["tall", "wide", "dependent", "square", "zero", "row", "column"])
def test_one_contract_at_all_sizes(spark, kind, full):
    rng = np.random.default_rng(3)
    x = {
        "tall": rng.normal(size=(40, 5)), "wide": rng.normal(size=(4, 30)), "dependent": rng.normal(size=(50, 5))[:, [0, 1, 1, 2, 2]],
        "square": rng.normal(size=(6, 6)), "zero": np.zeros((7, 3)), "row": rng.normal(size=(1, 9)), "column": rng.normal(size=(9, 1)),
    }[kind]
    (m, n), k = x.shape, min(x.shape)
    for limit in (0, 10**6):
        f = D.svd(Matrix.of(spark, x), limit, full)
        u, vt = f.left.to_numpy(), f.right.to_numpy()
        assert (u.shape, vt.shape, len(f.values)) == (((m, m), (n, n), k) if full else ((m, k), (k, n), k))
        assert np.abs(u.T @ u - np.eye(u.shape[1])).max() < 1e-12 and np.abs(vt @ vt.T - np.eye(len(vt))).max() < 1e-12
        assert np.allclose(u[:, :k] * f.values @ vt[:k], x, atol=1e-12) and np.allclose(f.values, np.linalg.svd(x, compute_uv=False), atol=1e-12)
        q, r = (a.to_numpy() for a in D.qr(Matrix.of(spark, x), limit, full))
        assert (q.shape, r.shape) == (((m, m), (m, n)) if full else ((m, k), (k, n)))
        assert np.abs(q.T @ q - np.eye(q.shape[1])).max() < 1e-12 and np.allclose(q @ r, x, atol=1e-12) and not np.tril(r, -1).any()


def test_completed_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(D.products, "SMALL", 0)
    x = np.random.default_rng(9).normal(size=(300, 3))
    u = D.svd(Matrix.of(spark, x), driver_elements=0).left.to_numpy()
    assert u.shape == (300, 300) and np.abs(u.T @ u - np.eye(300)).max() < 1e-12


def test_a_shorter_side_beyond_the_driver_is_refused(spark):
    a = Matrix.zeros(spark, 3000, 2500)
    for decompose in (D.svd, D.qr):
        with pytest.raises(ValueError, match="shorter side"):
            decompose(a)


def tall_svd(spark, x):
    f = D.svd(Matrix.of(spark, x), driver_elements=0, full=False)
    u = f.left.to_numpy()
    assert np.abs(u.T @ u - np.eye(u.shape[1])).max() < 1e-12 and np.abs(rebuilt(f) - x).max() <= 1e-13 * np.abs(x).max()
    return f.values


def test_tall_svd_of_graded_values(spark):
    rng = np.random.default_rng(5)
    u, v = (np.linalg.qr(rng.normal(size=(n, 13)))[0] for n in (300, 13))
    graded = 10.0 ** -np.arange(13)
    assert np.allclose(tall_svd(spark, u * graded @ v.T), graded, rtol=1e-2, atol=0)


@pytest.mark.parametrize("x", [np.zeros((9, 3)), np.ones((40, 2)), np.vander(np.arange(50) / 50, 20), np.arange(12.0).reshape(3, 4), np.eye(5)[:, [0, 1, 1, 2, 2]]])
def test_tall_svd_of_dependent_columns(spark, x):
    assert np.allclose(tall_svd(spark, x), np.linalg.svd(x, compute_uv=False), atol=1e-12)
    wide = np.hstack([x, x[:, :1]])
    tall_svd(spark, wide)


def test_qr(spark):
    i, j = np.indices((96, 40))
    x = np.cos(0.07 * (i + 1) * (j + 2))
    q, r = (m.to_numpy() for m in D.qr(Matrix.of(spark, x)))
    assert q.shape == (96, 96) and np.abs(q @ r - x).max() < 2e-10 and not np.tril(r, -1).any()


def test_tall_qr_of_graded_columns(spark):
    rng = np.random.default_rng(6)
    u, v = (np.linalg.qr(rng.normal(size=(n, 10)))[0] for n in (200, 10))
    x = u * 10.0 ** -np.arange(10) @ v.T
    q, r = (m.to_numpy() for m in D.qr(Matrix.of(spark, x), driver_elements=0, full=False))
    assert np.abs(q.T @ q - np.eye(10)).max() < 1e-12 and np.abs(q @ r - x).max() < 1e-12 and not np.tril(r, -1).any()


def test_eigh(spark):
    assert np.allclose(D.eigh(Matrix.of(spark, [[2, 1], [1, 2.0]])), [3, 1], atol=1e-9)
    x = 2 * np.eye(64) + np.eye(64, k=1) + np.eye(64, k=-1)
    expected = 2 + 2 * np.cos(np.arange(1, 65) * np.pi / 65)
    assert np.abs(D.eigh(Matrix.of(spark, x)) - expected).max() < 2e-11


def test_solve(spark):
    a = Matrix.of(spark, [[4, 1], [2, 3.0]])
    assert np.allclose(D.solve(a, Matrix.of(spark, [[5], [7.0]])).to_numpy().ravel(), [0.8, 1.8])
    with pytest.raises(ValueError, match="singular"):
        D.solve(Matrix.of(spark, [[1, 2], [2, 4.0]]), Matrix.of(spark, [[1], [1.0]]))
    for op in (D.svd, D.qr, D.eigh):
        with pytest.raises(ValueError):
            op(Matrix.zeros(spark, 0, 0))
    with pytest.raises(ValueError):
        D.eigh(Matrix.zeros(spark, 2, 3))


@pytest.mark.parametrize("n,extra,limit", [(60, 2, 0), (23, 1, 23 * 7), (16, 5, 0)])
def test_solve_in_panels(spark, n, extra, limit):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=(n, n)), rng.normal(size=(n, extra))
    x[: n // 2, : n // 2] = 0  # needs rows from below
    got = D.solve(Matrix.of(spark, x), Matrix.of(spark, y), driver_elements=limit).to_numpy()
    assert np.allclose(got, np.linalg.solve(x, y), atol=1e-8)
    x[:, 3] = x[:, 5]
    with pytest.raises(ValueError, match="singular"):
        D.solve(Matrix.of(spark, np.round(x)), Matrix.of(spark, y), driver_elements=limit)


def test_solve_of_sparse(spark):
    cells = [(i, j, float(v)) for i in range(20) for j, v in ((i, 4), ((i + 3) % 20, -1), ((i + 7) % 20, 2))]
    a = Matrix(spark.createDataFrame(cells, "row long, col long, v double"), 20, 20, sparse=True)
    b = np.arange(20.0)[:, None]
    for limit in (0, 10**6):
        assert np.allclose(D.solve(a, Matrix.of(spark, b), limit).to_numpy(), np.linalg.solve(a.to_numpy(), b))


@pytest.mark.parametrize("step", [1, 4, 1000])
def test_files(spark, tmp_path, step):
    x = np.random.default_rng(1).random((7, 5))
    path = str(tmp_path / "m.bin")
    matrix_file.write_matrix(Matrix.of(spark, x), path, step)
    raw = (tmp_path / "m.bin").read_bytes()
    assert np.frombuffer(raw[:16], "<i8").tolist() == [7, 5] and np.array_equal(np.frombuffer(raw[16:], "<f8").reshape(5, 7).T, x)
    assert np.array_equal(matrix_file.read_matrix(spark, path).to_numpy(), x) and matrix_file.shape_of(path) == (7, 5)
    matrix_file.write_matrix(Matrix.of(spark, x).by_rows(), path, step)
    assert (tmp_path / "m.bin").read_bytes() == raw
    v = spark.createDataFrame([(i, float(x[0, i])) for i in (3, 1, 0, 4, 2)], "row long, v double")
    matrix_file.write_vector(v, 5, str(tmp_path / "v.bin"), step)
    assert [tuple(r) for r in matrix_file.read_vector(spark, str(tmp_path / "v.bin")).orderBy("row").collect()] == list(enumerate(x[0].tolist()))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["m.bin", "v.bin"]


def test_files_on_a_store_without_places_are_folders_of_parts(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(1).random((6, 5))
    monkeypatch.setattr(matrix_file, "_is_mounted", lambda system: False)
    rows = [(i + j * 6, float(x[i, j])) for j in range(5) for i in range(6)]
    writer = matrix_file._Writer({"path": str(tmp_path / "m"), "shape": "6,5", "stage": "s.tmp"})
    (tmp_path / "m.s.tmp").mkdir()
    (tmp_path / "m.s.tmp" / "shape").write_bytes(np.array([6, 5], "<i8").tobytes())
    batches = lambda part: [matrix_file.pa.RecordBatch.from_pydict({"lin": [r[0] for r in part], "v": [r[1] for r in part]})]
    messages = [writer.write(iter(batches(part))) for part in (rows[:7], rows[7:20], rows[20:])]
    writer.commit(messages)
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["part-0", "part-20", "part-7", "shape"]
    assert np.array_equal(matrix_file.read_matrix(spark, str(tmp_path / "m")).to_numpy(), x)


def test_bad_files(spark, tmp_path):
    matrix_file.write_matrix(Matrix.zeros(spark, 0, 3), str(tmp_path / "empty.bin"))
    assert matrix_file.read_matrix(spark, str(tmp_path / "empty.bin")).df.count() == 0
    (tmp_path / "bad.bin").write_bytes(np.array([2, 2], "<i8").tobytes() + b"\0" * 8)
    with pytest.raises(ValueError, match="not a matrix file"):
        matrix_file.shape_of(str(tmp_path / "bad.bin"))
    short = spark.createDataFrame([(0, 1.0)], "row long, v double")
    with pytest.raises(Exception, match="1 elements came"):
        matrix_file.write_vector(short, 2, str(tmp_path / "short.bin"))
    assert not list(tmp_path.glob("short*"))
