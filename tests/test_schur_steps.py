import numpy as np
import pyarrow as pa
import pytest

from gridloom.operators import leastsquares as L


def residuals(seed=1, n=60, primaries=7, eliminated=5, dp=3, de=2):
    """Rows of one to three residuals, with none to three primaries, a third without an eliminated block."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        m, many = int(rng.integers(1, 4)), int(rng.integers(0, 4))
        has = not many or k % 3 > 0
        ps = rng.choice(primaries, many, replace=False).tolist()
        jp = [rng.integers(-3, 4, m * dp).astype(float).tolist() for _ in ps]
        je = rng.integers(-3, 4, m * de).astype(float).tolist() if has else None
        rows.append((k, ps, int(rng.integers(eliminated)) if has else None, jp, je, rng.integers(-3, 4, m).astype(float).tolist(), None if k % 4 == 0 else float(k % 3)))
    return rows


def brute(rows, primaries, eliminated, dp, de):
    h = np.zeros((primaries * dp + eliminated * de,) * 2)
    g = np.zeros(len(h))
    for _, ps, e, jp, je, r, w in rows:
        j = np.zeros((len(r), len(h)))
        for i, x in zip(ps, jp):
            j[:, i * dp : (i + 1) * dp] = np.reshape(x, (-1, dp))
        if e is not None:
            j[:, primaries * dp + e * de :][:, :de] = np.reshape(je, (-1, de))
        w = 1.0 if w is None else w
        h += w * j.T @ j
        g += w * j.T @ np.array(r)
    return h, g


def test_rows_of_all_sizes_are_multiplied_in_batches(spark):
    rows = residuals()
    eq = L.NormalEquations.of(L.residual_table(spark, rows), 7, 5, 3, 2)
    h, g = brute(rows, 7, 5, 3, 2)
    assert np.array_equal(eq.matrix("pp").to_numpy(), h[:21, :21])
    assert np.array_equal(eq.matrix("pe").to_numpy(), h[:21, 21:])
    assert np.array_equal(eq.matrix("ee").to_numpy(), h[21:, 21:])
    found = {(r["row"]): r["v"] for r in eq.gradient("gp").collect()}
    assert all(found.get(i, 0.0) == g[i] for i in range(21))


@pytest.mark.parametrize("cells", [False, True])
def test_implicit_products_take_one_job(spark, cells):
    rows = residuals(2)
    eq = L.NormalEquations.of(L.residual_table(spark, rows), 7, 5, 3, 2)
    eq = L.NormalEquations(L.materialise(eq.sums if cells else eq.table, "test"), 7, 5, 3, 2)
    eq = L.NormalEquations(eq.by_blocks(), 7, 5, 3, 2)
    inverses, ok = L._inverses(L._damped_blocks(eq.blocks("ee"), 5, 2, 0.5, 1e-3), 2)
    own = L._damped_blocks(eq.blocks("pp"), 7, 3, 0.5, 1e-3).selectExpr("i", "i AS j", "values")
    primary = L.materialise(own.unionByName(eq.blocks("pp").where("i <> j")), "test")
    h, _ = brute(rows, 7, 5, 3, 2)
    h[np.diag_indices(len(h))] += 0.5 * np.maximum(np.abs(h.diagonal()), 1e-3)
    v = h[21:, 21:]
    s = h[:21, :21] - h[:21, 21:] @ np.linalg.inv(v) @ h[21:, :21]
    x = np.arange(21.0) - 9
    operator = L._Implicit(eq, inverses, primary)
    try:
        assert ok and np.allclose(operator.apply(x), s @ x)
    finally:
        operator.release()
    diagonal = {r["i"]: r["values"] for r in L._schur_diagonal(eq, primary, inverses).collect()}
    assert all(np.allclose(np.reshape(diagonal[i], (3, 3)), s[3 * i : 3 * i + 3, 3 * i : 3 * i + 3]) for i in range(7))


def test_products_of_many_ids_leave_in_pieces(monkeypatch):
    monkeypatch.setattr(L, "PIECE", 1000)
    ids = [[{"i": i, "values": [1.0 * i, k]} for i in range(20)] for k in range(50)]
    kind = pa.list_(pa.struct([("i", pa.int64()), ("values", pa.list_(pa.float64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.nulls(50, kind), pa.array([[2.0]] * 50), pa.nulls(50, pa.list_(pa.float64()))], ["x", "y", "inverse", "g"])

    class Pairs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return list(run([batch]))

    made = L._products(Pairs(), 2, 1)
    assert max(len(b.column("values").flatten()) for b in made) <= 3 * 1000
    assert sum(b.num_rows for b in made) == 50 * 20 * 20


def test_implicit_products_touch_few_rows_in_a_task(spark):
    """Ids in four groups, each with primaries of its own: a task of neighbouring ids meets those of one or two groups."""
    rows = [(k, [k // 50 * 10 + k % 10], k, [[1.0]], [1.0], [1.0], None) for k in range(200)]
    eq = L.NormalEquations.of(L.residual_table(spark, rows), 40, 200, 1, 1)
    inverses, _ = L._inverses(L._damped_blocks(eq.blocks("ee"), 200, 1, 0.5, 1e-3), 1)
    operator = L._Implicit(eq, inverses, eq.blocks("pp").limit(0))
    met = operator.cross.selectExpr("spark_partition_id() AS task", "i").distinct().count()
    operator.release()
    assert met <= 40 + 3 * 10  # three borders inside groups at most; 160 where ids are dealt out by hash


def test_products_are_added_up_before_they_are_shuffled(monkeypatch):
    """50 ids of the same 20 primaries: a task gives each place on or below the diagonal once, not 50 times both triangles."""
    monkeypatch.setattr(L, "PIECE", 1000)
    ids = [[{"i": i, "values": [1.0 * i, k]} for i in range(20)] for k in range(50)]
    kind = pa.list_(pa.struct([("i", pa.int64()), ("values", pa.list_(pa.float64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.nulls(50, kind), pa.array([[2.0]] * 50), pa.array([[3.0]] * 50)], ["x", "y", "inverse", "g"])

    class Pairs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return list(run([batch]))

    for hold, most in ((1 << 23, 20 * 21 // 2 + 20), (100, None)):
        monkeypatch.setattr(L, "HOLD", hold)
        every, few = ({}, {})
        for found, added in ((every, False), (few, True)):
            for b in L._products(Pairs(), 2, 1, added):
                for i, j, v in zip(*(b.column(c).to_pylist() for c in ("i", "j", "values"))):
                    if i >= j:
                        found[i, j] = found.get((i, j), 0) + np.array(v)
        assert every.keys() == few.keys() and all(np.allclose(every[k], few[k]) for k in every)
        if most:
            assert sum(b.num_rows for b in L._products(Pairs(), 2, 1, True)) == most


def test_a_fit_does_not_put_blocks_together_again(spark, monkeypatch):
    from gridloom.plans import catalogue

    kinds = []
    real = L.NormalEquations.by_blocks
    monkeypatch.setattr(L.NormalEquations, "by_blocks", lambda eq: kinds.append("v" in eq.table.columns) or real(eq))
    catalogue.QUERIES["lm_fit"](spark, "/root/testdata/sf0.001")
    assert kinds and not any(kinds)
