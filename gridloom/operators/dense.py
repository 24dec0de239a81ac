"""Decompositions and solves of dense matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..matrix import BROADCAST_ROWS, BY_ROWS, DRIVER_ELEMENTS, Matrix
from ..scratch import drop_folders, folders_of, materialise
from . import products
from .rows import compact

#: Pivots below this make a system singular.
PIVOT = 1e-15
#: Of a sparse system one in so many indices at least is eliminated at once, or none; their diagonal elements are so large in their columns.
LEAVES, STEADY = 4, 0.1
#: Blocks of a band that are changed at once, so that they stay in the processor's cache.
WINDOWS = 64
#: So many n x n factors reach the driver from a tall matrix.
STACKS = 16


class Singular(ValueError):
    """A matrix without an inverse, or one that is not positive definite where it must be."""


@dataclass(frozen=True)
class Factors:
    """Left and right factors as relations; values as an array at the driver."""

    left: Matrix
    values: np.ndarray
    right: Matrix


def _some(a: Matrix) -> None:
    if not a.rows or not a.cols:
        raise ValueError("a dimension is zero")


def _narrow(a: Matrix, driver_elements: int) -> Matrix:
    """A tall matrix in rows, of which n x n numbers fit the driver; elements are brought into rows once and written."""
    if a.cols * a.cols > DRIVER_ELEMENTS:
        raise ValueError(f"the shorter side of {a.rows} x {a.cols} is too long: {a.cols} x {a.cols} numbers must fit the driver")
    if a.layout == BY_ROWS:
        return a
    return Matrix(materialise(a.by_rows().source, "rows"), *a.shape, layout=BY_ROWS)


def svd(a: Matrix, driver_elements: int = DRIVER_ELEMENTS, full: bool = True) -> Factors:
    """A = U diag(s) Vt with k = min(m, n) values s, descending.

    U is m x m and Vt n x n, completed by orthonormal columns and rows; with full=False they are
    m x k and k x n. What fits the driver is decomposed there. Else a tall matrix is decomposed
    through the R of its QR factors, A = Q R with R = Ur S Vt, so values are as accurate as at the
    driver and only n x n numbers are shuffled; a wide one as its transpose. The thin factor is a
    projection A V / s of the rows, made orthonormal by QR factors of its own; columns whose value
    is lost in rounding are completed from pseudorandom rows. The shorter side must fit the driver.
    """
    _some(a)
    if a.size <= driver_elements:
        u, s, vt = np.linalg.svd(a.to_numpy(driver_elements), full_matrices=full)
        return Factors(Matrix.of(a.spark, u), s, Matrix.of(a.spark, vt))
    if a.rows < a.cols:
        f = svd(a.transpose(), driver_elements, full)
        return Factors(f.right.transpose(), f.values, f.left.transpose())
    a = _narrow(a, driver_elements)
    _, s, vt = np.linalg.svd(_stacked(a.row_arrays(), a.cols), full_matrices=False)
    left = _left(a, s, vt)
    return Factors(completed(left) if full else left, s, Matrix.of(a.spark, vt))


def _left(a: Matrix, s: np.ndarray, vt: np.ndarray, last: np.ndarray | None = None) -> Matrix:
    """U of A = U diag(s) Vt, m x n with orthonormal columns whatever the rank of A; times `last` if given."""
    keep = s > s[0] * a.cols * np.finfo(float).eps
    while True:
        first = np.where(keep, vt.T / np.where(keep, s, 1), 0.0)
        r = _positive(_stacked(_left_rows(a, first, [], ~keep), len(s)))
        lost = keep & (np.diag(r) < 0.5)  # what is left of the column is rounding noise
        if not lost.any():
            break
        keep = keep & (np.arange(len(s)) < lost.argmax())
    then = [np.linalg.inv(r)]
    while np.linalg.cond(r) > 10 and len(then) < 4:
        r = _positive(_stacked(_left_rows(a, first, then, ~keep), len(s)))
        then.append(np.linalg.inv(r))
    left = _left_rows(a, first, [*then, last] if last is not None else then, ~keep)
    return Matrix.from_arrays(left, "row", "values", a.rows, len(s))


def completed(w: Matrix) -> Matrix:
    """An orthonormal m x m matrix whose first n columns are those of w, an m x n matrix in rows with orthonormal columns.

    w is the beginning of a product of n reflections, I - Y T Yᵀ: the top of w, less a matrix of
    signs, is factored into triangles at the driver, which gives T and, row by row, Y. Only the
    product of Y and T Yᵀ, in tiles, has m x m numbers.
    """
    m, n = w.shape
    if m == n:
        return w
    top = np.zeros((n, n))
    for row in w.row_arrays().where(F.col("row") < n).toLocalIterator():
        top[row["row"]] = row["values"]
    signs, low, up = np.ones(n), np.eye(n), top.copy()
    for i in range(n):
        signs[i] = -1.0 if up[i, i] >= 0 else 1.0
        up[i, i] -= signs[i]
        low[i + 1 :, i] = up[i + 1 :, i] / up[i, i]
        up[i + 1 :, i] = 0
        up[i + 1 :, i + 1 :] -= np.outer(low[i + 1 :, i], up[i, i + 1 :])
    t = -(up * signs) @ np.linalg.inv(low).T
    up_inverse = np.linalg.inv(up)

    def reflectors(last: np.ndarray, scaled: bool):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    row = batch.column("row").to_numpy()
                    y = batch.column("values").flatten().to_numpy().reshape(-1, n) @ up_inverse
                    inside = row < n
                    y[inside] = low[row[inside]]
                    y = y @ last
                    if scaled:
                        y[inside] *= signs[row[inside], None]
                    yield products._row_arrays(row, y)

        return Matrix(w.row_arrays().mapInArrow(run, "row long, values array<double>"), m, n, layout=BY_ROWS)

    far = products.gemm(reflectors(np.eye(n), False), reflectors(t.T, True).transpose())
    sign = F.when(F.substring(F.lit("".join("-" if s < 0 else "+" for s in signs)), (F.col("row") + 1).cast("int"), F.lit(1)) == "-", F.lit(-1.0)).otherwise(F.lit(1.0))
    return far.with_values(F.when(F.col("row") == F.col("col"), sign).otherwise(F.lit(0.0)) - F.col("v"))


def _stacked(rows: DataFrame, n: int) -> np.ndarray:
    """R of a QR factorization of the row form of a matrix with n columns: tasks factor their rows, then the stacked factors."""

    def part(batches):
        held = np.zeros((0, n))
        for batch in batches:
            if batch.num_rows:
                held = np.linalg.qr(np.vstack([held, batch.column("values").flatten().to_numpy().reshape(-1, n)]), mode="r")
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(list(map(list, held)))], ["values"])

    rows = rows.select("values").mapInArrow(part, "values array<double>")
    rows = rows.repartition(STACKS).mapInArrow(part, "values array<double>")  # the tasks' factors, stacked and factored again
    return np.triu(np.linalg.qr(np.array([row["values"] for row in rows.collect()]), mode="r"))


def _positive(r: np.ndarray) -> np.ndarray:
    """R with a diagonal that is not negative, so that A R⁻¹ keeps the directions of A's columns."""
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def _left_rows(a: Matrix, first: np.ndarray, then: list[np.ndarray], filled: np.ndarray) -> DataFrame:
    """The row form of A first, with pseudorandom `filled` columns, times the matrices of `then`.

    A first cancels where singular values are small. Its rounding must be the same each time a
    row is computed, whatever batch the row is in, so it is summed column by column.
    """
    k, at, size = first.shape[1], np.flatnonzero(filled), np.sqrt(12.0 / a.rows)

    def run(batches):
        for batch in batches:
            x = batch.column("values").flatten().to_numpy().reshape(-1, len(first)).astype(float)
            y = np.zeros((len(x), k))
            for j in range(len(first)):
                y += x[:, j : j + 1] * first[j]
            row = batch.column("row").to_numpy().astype(np.uint64)
            for j in at:  # splitmix64 of the element's number
                z = (row * np.uint64(k) + np.uint64(j + 1)) * np.uint64(0x9E3779B97F4A7C15)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                y[:, j] = (((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 - 0.5) * size
            for m in then:
                y = y @ m
            offsets = np.arange(0, y.size + 1, k, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel()))], ["row", "values"])

    return a.row_arrays().mapInArrow(run, "row long, values array<double>")


def qr(a: Matrix, driver_elements: int = DRIVER_ELEMENTS, full: bool = True) -> tuple[Matrix, Matrix]:
    """A = Q R with orthonormal Q and upper triangular R, zeros below the diagonal, for any shape and rank.

    Q is m x m and R m x n; with full=False Q is m x k and R k x n, k = min(m, n). What fits the
    driver is factored there by reflections. Else each task of a tall matrix factors its rows, and
    their R factors are stacked and factored; as R = Ur S Vt, Q is the thin U of A times Urᵀ, which
    needs no inverse of R, so columns may be dependent. A wide matrix is factored through its first
    m columns, and R = Qᵀ A is a projection of the columns. The shorter side must fit the driver.
    """
    _some(a)
    if a.size <= driver_elements:
        q, r = np.linalg.qr(a.to_numpy(driver_elements), mode="complete" if full else "reduced")
        return Matrix.of(a.spark, q), Matrix.of(a.spark, np.triu(r))
    if a.rows < a.cols:
        return _wide_qr(a, driver_elements)
    a = _narrow(a, driver_elements)
    r = _stacked(a.row_arrays(), a.cols)
    u, s, vt = np.linalg.svd(r)
    q = _left(a, s, vt, u.T)
    if not full:
        return q, Matrix.of(a.spark, r)
    cells = Matrix.of(a.spark, r).df
    return completed(q), Matrix(cells, *a.shape, sparse=True).dense()


def _wide_qr(a: Matrix, driver_elements: int) -> tuple[Matrix, Matrix]:
    columns = _narrow(a.transpose(), driver_elements)
    m = a.rows
    first = np.zeros((m, m))
    for row in columns.row_arrays().where(F.col("row") < m).toLocalIterator():
        first[:, row["row"]] = row["values"]
    q, r = np.linalg.qr(first)

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                row = batch.column("row").to_numpy()
                values = batch.column("values").flatten().to_numpy().reshape(-1, m) @ q
                values[row < m] = np.triu(r).T[row[row < m]]
                yield products._row_arrays(row, values)

    turned = columns.row_arrays().mapInArrow(project, "row long, values array<double>")
    return Matrix.of(a.spark, q), Matrix(turned, a.cols, m, layout=BY_ROWS).transpose()


def eigh(a: Matrix, driver_elements: int = DRIVER_ELEMENTS) -> np.ndarray:
    """Eigenvalues of a square matrix, descending; its symmetric part is taken.

    What fits the driver is decomposed there. Else reflections reduce the matrix to a band, panel
    by panel: the driver gets the columns of a panel and finds the reflections, and every task
    changes its rows where they are, so nothing is shuffled. The driver reduces the band to three
    diagonals, in time n² over the band's width, and tasks find the eigenvalues in them by
    bisection, each a range of their numbers. The driver must hold 16 columns. A sparse matrix
    whose rows can be put in an order in which its elements are near the diagonal is a band
    already, see _narrow_band(); no full matrix is made of it.
    """
    if a.rows != a.cols:
        raise ValueError("the matrix is not square")
    _some(a)
    if a.size <= driver_elements:
        x = a.to_numpy(driver_elements)
        return np.linalg.eigvalsh((x + x.T) / 2)[::-1]
    if a.sparse and (band := _narrow_band(a)) is not None:
        return _bisected(a.spark, *_tridiagonal(band, len(band) - 1))[::-1]
    if 16 * a.rows > DRIVER_ELEMENTS:
        raise ValueError(f"{a.rows} rows are too many: 16 columns must fit the driver")
    width = int(np.clip(driver_elements // a.rows, 1, 64))
    diagonal, beside = _tridiagonal(_banded(a, width, driver_elements), width)
    return _bisected(a.spark, diagonal, beside)[::-1]


def _reflections(panel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """V, T and R with panel = (I - V T V') R, R upper triangular on top of zeros."""
    r, k = panel.copy(), min(panel.shape)
    v, t = np.zeros((len(r), k)), np.zeros((k, k))
    for j in range(k):
        x = r[j:, j]
        norm = np.sqrt(np.sum(x * x))
        if not norm:
            continue
        u = x.copy()
        u[0] += np.copysign(norm, x[0])
        tau = 2 / np.sum(u * u)
        v[j:, j] = u
        r[j:, j:] -= np.outer(tau * u, u @ r[j:, j:])
        t[:j, j] = -tau * (t[:j, :j] @ (v[:, :j].T @ v[:, j]))
        t[j, j] = tau
    return v, t, np.triu(r[:k])


def _banded(a: Matrix, width: int, driver_elements: int) -> np.ndarray:
    """A matrix with the eigenvalues of a's symmetric part and `width` diagonals below the main one: line d of the result is diagonal d."""
    n = a.rows
    band = np.zeros((width + 1, n))

    def keep(block: np.ndarray, row: int, col: int) -> None:
        i, j = np.indices(block.shape)
        d = row + i - col - j
        near = (d >= 0) & (d <= width)
        band[d[near], col + j[near]] = block[near]

    turned = a.transpose()
    halves = Matrix(a.df.unionByName(turned.df).groupBy("row", "col").agg((F.sum("v") / 2).alias("v")), n, n, sparse=a.sparse)
    left = materialise(halves.by_rows().row_arrays(), "band")
    at = 0
    while (n - at) * (n - at) > driver_elements and n - at > width:
        got = left.select("row", F.slice("values", 1, width).alias("values")).toArrow()
        order = np.argsort(got.column("row").to_numpy())
        head = got.column("values").combine_chunks().flatten().to_numpy().reshape(-1, width)[order]
        v, t, r = _reflections(head[width:])
        keep(head[:width], at, at)
        keep(r, at + width, at)
        first = at + width

        def product(batches, v=v, t=t, first=first, size=n - at):
            for batch in batches:
                if batch.num_rows:
                    values = batch.column("values").flatten().to_numpy().reshape(-1, size)[:, width:]
                    yield products._row_arrays(batch.column("row").to_numpy(), values @ v @ t)

        below = left.where(F.col("row") >= first)
        got = below.mapInArrow(product, "row long, values array<double>").toArrow()
        order = np.argsort(got.column("row").to_numpy())
        y = got.column("values").combine_chunks().flatten().to_numpy().reshape(n - first, -1)[order]
        w = y - v @ (t.T @ (v.T @ y)) / 2

        def changed(batches, v=v, w=w, first=first, size=n - at):
            for batch in batches:
                if batch.num_rows:
                    row = batch.column("row").to_numpy()
                    values = batch.column("values").flatten().to_numpy().reshape(-1, size)[:, width:]
                    yield products._row_arrays(row, values - w[row - first] @ v.T - v[row - first] @ w.T)

        after = materialise(below.mapInArrow(changed, "row long, values array<double>"), "band")
        drop_folders(a.spark, folders_of(left))
        left, at = after, first
    rest = np.zeros((n - at, n - at))
    for row in left.toLocalIterator():
        rest[row["row"] - at] = row["values"]
    drop_folders(a.spark, folders_of(left))
    while len(rest):
        keep(rest[:width, :width], at, at)
        if len(rest) > width:
            v, t, r = _reflections(rest[width:, :width])
            keep(r, at + width, at)
            y = rest[width:, width:] @ v @ t
            w = y - v @ (t.T @ (v.T @ y)) / 2
            rest = rest[width:, width:] - w @ v.T - v @ w.T
        else:
            rest = rest[:0]
        at += width
    return band


def _narrow_band(a: Matrix) -> np.ndarray | None:
    """The symmetric part of a sparse a as _banded() returns it, rows ordered by their distance from one at an end; None if it is wider than 64 or the driver's elements."""
    n = a.rows
    turned = a.transpose()
    halves = a.df.where("v <> 0").unionByName(turned.df.where("v <> 0")).groupBy("row", "col").agg((F.sum("v") / 2).alias("v"))
    most = min(64 * n, DRIVER_ELEMENTS // 3)
    got = halves.limit(most + 1).toArrow()
    if len(got) > most:
        return None
    row, col, v = (got.column(c).to_numpy() for c in ("row", "col", "v"))
    order = np.argsort(row, kind="stable")
    row, col, v = row[order], col[order], v[order]
    start = np.searchsorted(row, np.arange(n + 1))
    degree = np.diff(start)

    def reached(first: int, place: np.ndarray) -> list[int]:
        """All that are linked with `first`, in order of distance; `place` tells which are taken."""
        found = [first]
        place[first] = 1
        for i in found:
            near = np.unique(col[start[i] : start[i + 1]])
            near = near[place[near] == 0]
            place[near] = 1
            found.extend(near[np.argsort(degree[near], kind="stable")].tolist())
        return found

    place, whole = np.zeros(n, np.int8), []
    for i in np.argsort(degree, kind="stable").tolist():
        if not place[i]:
            far = reached(i, place)
            for _ in range(2):  # from the end that is farthest away
                place[far] = 0
                far = reached(far[-1], place)
            whole += far
    at = np.empty(n, np.int64)
    at[whole] = np.arange(n)
    low, high = at[row], at[col]
    width = max(1, int(np.abs(low - high).max(initial=0)))
    if width > 64 or (width + 1) * n > DRIVER_ELEMENTS:
        return None
    band = np.zeros((width + 1, n))
    below = low >= high
    band[(low - high)[below], high[below]] = v[below]
    return band


def _tridiagonal(band: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The main diagonal and the one beside it after rotations that keep the eigenvalues.

    A reflection clears a column below the second diagonal; what it fills in further down is chased off the end.
    """
    n = band.shape[1]
    if width < 2 or n < 3:
        return band[0].copy(), (band[1, : n - 1] if len(band) > 1 else np.zeros(n - 1)).copy()
    # Lines around the diagonal, wide enough for what is filled in, with rows of zeros on both ends. Reflections of one
    # step are four blocks apart, so they touch nothing in common: column j begins at step 4 j, and goes on a block a step.
    reach, before = 3 * width, width
    full = np.zeros((n + before + 4 * width, 2 * reach + 1))  # row before + i, column i + d - reach
    for d in range(width + 1):
        i = np.arange(n - d)
        full[before + i + d, reach - d] = band[d, : n - d]
        full[before + i, reach + d] = band[d, : n - d]
    s0, s1 = full.strides

    def windows(row: int, col: int, count: int, height: int, across: int) -> np.ndarray:
        """Views of blocks inside the lines, each 4 width - 1 further up than the one before."""
        offset = (before + row) * s0 + (col - row + reach) * s1
        return np.ndarray((count, height, across), full.dtype, full.data, offset, (-(4 * width - 1) * s0, s0 - s1, s1))

    first = 0  # the earliest column that is not done
    for step in range(4 * (n - 3) + (n - 2) // width + 1):
        last = min(step // 4, n - 3)
        while first <= last and first + 1 + (step - 4 * first) * width >= n - 1:
            first += 1
        count = last - first + 1
        if count <= 0:
            continue
        top = first + 1 + (step - 4 * first) * width
        x = windows(top, top - width, count, width, 1)[:, :, 0].copy()
        if step == 4 * last:  # this one begins: its column is the one beside
            x[-1] = windows(top - (count - 1) * (4 * width - 1), last, 1, width, 1)[0, :, 0]
        norm = np.sqrt(np.einsum("bi,bi->b", x, x))
        some = (norm > 0) & np.any(x[:, 1:], axis=1)
        if not some.any():
            continue
        x[:, 0] += np.copysign(norm, x[:, 0])
        squares = np.einsum("bi,bi->b", x, x)
        scaled = x * np.where(some, 2 / np.where(some, squares, 1), 0)[:, None]
        rows, cols = windows(top, top - width, count, width, 3 * width), windows(top - width, top, count, 3 * width, width)
        for at in range(0, count, WINDOWS):
            some = slice(at, at + WINDOWS)
            u, t, r, c = x[some], scaled[some], rows[some], cols[some]
            r -= t[:, :, None] * np.einsum("bi,bij->bj", u, r)[:, None, :]
            c -= np.einsum("bij,bj->bi", c, u)[:, :, None] * t[:, None, :]
    return full[before : before + n, reach].copy(), full[before : before + n - 1, reach + 1].copy()


def _bisected(spark, diagonal: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Eigenvalues of a symmetric tridiagonal matrix, ascending: how many lie below a number is the count of negative pivots."""
    n = len(diagonal)
    radius = np.append(np.abs(beside), 0) + np.append(0, np.abs(beside))
    low, high = float((diagonal - radius).min()), float((diagonal + radius).max())
    least = max(np.finfo(float).tiny, float((beside * beside).max(initial=0.0)) * np.finfo(float).tiny)
    squares = np.append(0.0, beside * beside)

    def found(batches):
        for batch in batches:
            number = batch.column("id").to_numpy()
            a, b = np.full(len(number), low), np.full(len(number), high)
            for _ in range(80):
                x = (a + b) / 2
                if np.all((x <= a) | (x >= b)):
                    break
                below, pivot = np.zeros(len(number), np.int64), np.ones(len(number))
                for d, e in zip(diagonal.tolist(), squares.tolist()):
                    pivot = d - x - e / pivot
                    pivot = np.where(np.abs(pivot) < least, -least, pivot)
                    below += pivot < 0
                more = below > number  # this eigenvalue lies below x
                a, b = np.where(more, a, x), np.where(more, x, b)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array((a + b) / 2)], ["id", "v"])

    got = spark.range(n).mapInArrow(found, "id long, v double").toArrow()
    out = np.zeros(n)
    out[got.column("id").to_numpy()] = got.column("v").to_numpy()
    return np.sort(out)


def _pivoted(panel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elimination of a panel with partial pivoting: the rows it takes, in order, the others, and what multiple of each taken row each other one loses.

    ValueError if a pivot is below PIVOT.
    """
    x, order, w = panel.copy(), np.arange(len(panel)), panel.shape[1]
    for j in range(w):
        p = j + int(np.abs(x[j:, j]).argmax())
        if not abs(x[p, j]) >= PIVOT:
            raise Singular("the matrix is singular")
        x[[j, p]], order[[j, p]] = x[[p, j]], order[[p, j]]
        x[j + 1 :, j] /= x[j, j]
        x[j + 1 :, j + 1 :] -= np.outer(x[j + 1 :, j], x[j, j + 1 :])
    low, factors = x[:w], x[w:].copy()  # the multipliers are of rows that lost others themselves
    for j in range(w - 2, -1, -1):
        factors[:, j] -= np.einsum("ik,k->i", factors[:, j + 1 :], low[j + 1 :, j])
    return order[:w], order[w:], factors


def _definite(a: np.ndarray) -> None:
    """Singular if the symmetric a is not positive definite."""
    try:
        if np.isfinite(np.linalg.cholesky(a)).all():
            return
    except np.linalg.LinAlgError:
        pass
    raise Singular("the matrix is not positive definite")


def _own_pivots(panel: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _pivoted() of a positive definite matrix, of which the panel's own rows are taken in their order."""
    taken, others = np.flatnonzero(own), np.flatnonzero(~own)
    _definite(panel[taken])
    return taken, others, np.linalg.solve(panel[taken].T, panel[others].T).T


def solve(a: Matrix, b: Matrix, driver_elements: int = DRIVER_ELEMENTS, definite: bool = False) -> Matrix:
    """X with A X = B, by elimination with partial pivoting; Singular, a ValueError, if a pivot is below PIVOT.

    What fits the driver is solved there. Else columns are eliminated panel by panel: the driver
    gets the columns of a panel, as many as fit, and finds its pivot rows; these rows and the
    multipliers go to every task, which changes the other rows where they are, so nothing is
    shuffled. Pivot rows are written as they were; the solution comes from them panel by panel,
    last first. The driver must hold 16 columns of A, and X. A sparse matrix that falls apart into
    components is solved by component: those that would fit the driver each in one task. Where one
    would not, indices that share no element are eliminated first, see _without_leaves(); as long as
    these are many, neither A nor X need fit the driver. With `definite` pivots are taken from the
    diagonal, and Singular is raised as well if A, which must be symmetric, is not positive definite.
    """
    if a.rows != a.cols or a.rows != b.rows:
        raise ValueError("the system is not square or the right side does not fit")
    n, extra = a.rows, b.cols
    if n * (n + extra) <= driver_elements:
        x = np.column_stack([a.to_numpy(), b.to_numpy()])
        if definite:
            _definite(x[:, :n])
        return Matrix.of(a.spark, _eliminated(x, n))
    if a.sparse and extra:
        known = n <= BROADCAST_ROWS and n * extra <= DRIVER_ELEMENTS
        of = _components(a) if known else np.zeros(1, np.int64)
        size = int(np.bincount(of).max()) if known else n
        if size * (size + extra) > driver_elements and (x := _without_leaves(a, b, driver_elements, definite)) is not None:
            return x
        if of.any():
            return Matrix.of(a.spark, _by_component(a, b, of, driver_elements, definite))
    if n * max(16, extra) > DRIVER_ELEMENTS:
        raise ValueError(f"{n} unknowns with {extra} right sides are too many")
    width = max(1, min(n, 512, max(driver_elements, 16 * n) // n))
    both = a.by_rows().row_arrays().join(b.by_rows().row_arrays().withColumnRenamed("values", "right"), "row")
    left = materialise(both.select("row", F.concat("values", "right").alias("values")), "elimination")
    panels = []
    for at in range(0, n, width):
        w, rest = min(width, n - at), n - at + extra
        got = left.select("row", F.slice("values", 1, w).alias("values")).toArrow()
        ids = got.column("row").to_numpy()
        panel = got.column("values").combine_chunks().flatten().to_numpy().reshape(-1, w)
        order = np.argsort(ids)
        ids, panel = ids[order], panel[order]
        taken, others, factors = _own_pivots(panel, (ids >= at) & (ids < at + w)) if definite else _pivoted(panel)
        pivots = ids[taken]
        chosen = F.col("row").isin([int(i) for i in pivots])
        kept = materialise(left.where(chosen), "pivot-rows")
        place = {int(i): k for k, i in enumerate(pivots)}
        head = np.zeros((w, rest))
        for row in kept.toLocalIterator():
            head[place[row["row"]]] = row["values"]
        panels.append((at, head[:, :w].copy(), place, kept))
        if at + w < n:
            others = others[sorting := np.argsort(ids[others])]
            factors, names = factors[sorting], ids[others]
            after = materialise(left.where(~chosen).mapInArrow(_reduced(names, factors, head[:, w:], w, rest), "row long, values array<double>"), "elimination")
            drop_folders(a.spark, folders_of(left))
            left = after
    drop_folders(a.spark, folders_of(left))
    x = np.zeros((n, extra))
    for at, square, place, kept in reversed(panels):
        w = len(square)
        right = np.zeros((w, extra))
        later = x[at + w :]

        def known(batches, w=w, later=later, end=n - at):
            for batch in batches:
                if batch.num_rows:
                    rows = batch.column("values").flatten().to_numpy().reshape(batch.num_rows, -1)
                    yield products._row_arrays(batch.column("row").to_numpy(), rows[:, end:] - rows[:, w:end] @ later)

        for row in kept.mapInArrow(known, "row long, values array<double>").toLocalIterator():
            right[place[row["row"]]] = row["values"]
        x[at : at + w] = _eliminated(np.column_stack([square, right]), w)
        drop_folders(a.spark, folders_of(kept))
    return Matrix.of(a.spark, x)


def _without_leaves(a: Matrix, b: Matrix, driver_elements: int, definite: bool = False) -> Matrix | None:
    """X with A X = B of a sparse A by elimination of all indices of a set that share no element; None if fewer than a LEAVES-th could be.

    An index may be taken whose diagonal element is at least STEADY times any other of its column,
    so that no multiplier is large; of two that share an element the one of fewer products, at most
    a hundredth of a full matrix's and TERMS. What is left, A_rr - A_re A_ee^-1 A_er, is a sparse
    product by ranges of rows; it is solved in turn, and then each taken index from its own row.
    """
    n, extra, spark = a.rows, b.cols, a.spark
    # right sides are columns from n on
    cells = a.df.where("v <> 0").select("row", "col", F.col("v").cast("double").alias("v"))
    cells = materialise(cells.unionByName(b.df.select("row", (F.col("col") + n).alias("col"), F.col("v").cast("double").alias("v"))), "leaves")
    near = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
    own = cells.where(F.col("col") < n)
    if definite and own.where("row = col AND v > 0").count() < n:
        raise Singular("the matrix is not positive definite")
    across = own.groupBy(F.col("row").alias("i")).agg(F.count(F.lit(1)).alias("across"))
    down = own.groupBy(F.col("col").alias("i")).agg(F.count(F.lit(1)).alias("down"), F.max(F.abs("v")).alias("top"), F.max(F.when(F.col("row") == F.col("col"), F.col("v"))).alias("d"))
    work = F.col("across") * F.col("down")
    steady = C.finite(F.col("d")) & (F.abs("d") >= PIVOT) & (F.abs("d") >= STEADY * F.col("top")) & (work <= max(64, min(products.TERMS, n * n // 100)))
    order = F.shiftleft(F.least(work, F.lit(2**31 - 1)), 32) + F.pmod(F.xxhash64("i"), F.lit(2**32))
    able = materialise(across.join(down, "i").where(steady).select("i", "d", order.alias("at")), "leaves")
    one, two = (near(able.select(F.col("i").alias(k), F.col("at").alias(f"{k}_at"))) for k in ("row", "col"))
    pairs = own.where("row <> col").select("row", "col").join(one, "row").join(two, "col")
    later = (F.col("row_at") > F.col("col_at")) | ((F.col("row_at") == F.col("col_at")) & (F.col("row") > F.col("col")))
    beaten = pairs.select(F.when(later, F.col("row")).otherwise(F.col("col")).alias("i")).distinct()
    taken = materialise(able.join(beaten, "i", "left_anti").select("i", "d"), "leaves")
    count = taken.count()
    if count * LEAVES < n:
        drop_folders(spark, folders_of(cells) | folders_of(able) | folders_of(taken))
        return None
    rows_, cols_ = (near(taken.select(F.col("i").alias(k), F.col("d").alias(f"{k}_d"))) for k in ("row", "col"))
    cells_ = materialise(cells.join(rows_, "row", "left").join(cols_, "col", "left").where("row <> col OR row_d IS NULL"), "leaves")
    drop_folders(spark, folders_of(cells) | folders_of(able))
    there, above, beside = (cells_.where(c) for c in ("row_d IS NULL AND col_d IS NULL", "row_d IS NOT NULL", "col_d IS NOT NULL"))
    lost = products.sparse_gemm(
        Matrix(beside.select("row", "col", (-F.col("v") / F.col("col_d")).alias("v")), n, n, sparse=True), Matrix(above.select("row", "col", "v"), n, n + extra, sparse=True)
    )
    rest = compact(spark.range(n).select(F.col("id").alias("i")).join(near(taken.select("i")), "i", "left_anti"), "i", F.lit(True), "new")
    rest = materialise(rest.select("i", "new"), "leaves")
    left = there.select("row", "col", "v").unionByName(lost.df.select("row", "col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v"))
    left = left.join(near(rest.withColumnsRenamed({"i": "row", "new": "to"})), "row").select(F.col("to").alias("row"), "col", "v")
    left = materialise(left, "leaves")
    m = n - count
    known = None
    if m:
        inner = left.where(F.col("col") < n).join(near(rest.withColumnsRenamed({"i": "col", "new": "to"})), "col").select("row", F.col("to").alias("col"), "v")
        side = left.where(F.col("col") >= n).select("row", (F.col("col") - n).alias("col"), "v")
        x = solve(Matrix(materialise(inner, "leaves"), m, m, sparse=True), Matrix(side, m, extra, sparse=True), driver_elements, definite)
        known = materialise(x.df.join(near(rest), F.col("row") == F.col("new")).select(F.col("i").alias("row"), "col", F.col("v").cast("double").alias("v")), "solved")
    zero = taken.select(F.col("i").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(extra - 1).cast("long"))).alias("col"), F.lit(0.0).alias("v"))
    terms = above.where(F.col("col") >= n).select("row", (F.col("col") - n).alias("col"), (F.col("v") / F.col("row_d")).alias("v")).unionByName(zero)
    if m:
        far = known.select(F.col("row").alias("k"), F.col("col").alias("side"), F.col("v").alias("x"))
        far = F.broadcast(far) if m * extra <= BROADCAST_ROWS else far
        gone = above.where(F.col("col") < n).join(far, F.col("col") == F.col("k"))
        terms = terms.unionByName(gone.select("row", F.col("side").alias("col"), (-F.col("v") * F.col("x") / F.col("row_d")).alias("v")))
    found = terms.groupBy("row", "col").agg(F.sum("v").alias("v"))
    return Matrix(found.unionByName(known) if m else found, n, extra)


def _joined(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Of each number the least one that it is joined with, by pairs a, b more than before."""
    while True:
        x, y = of[a], of[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(of, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(of[of], of):
            of[:] = of[of]


def _components(a: Matrix) -> np.ndarray:
    """The least index that each index of a square sparse matrix is linked with by elements other than 0."""
    n = a.rows

    def forest(batches):
        of = np.arange(n)
        for batch in batches:
            _joined(of, batch.column("row").to_numpy(), batch.column("col").to_numpy())
        linked = np.flatnonzero(of != np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array(linked), pa.array(of[linked])], ["row", "col"])

    links = a.df.where("row <> col AND v <> 0").select("row", "col").mapInArrow(forest, "row long, col long")
    got = links.repartition(8).mapInArrow(forest, "row long, col long").toArrow()  # so that few copies of n reach the driver
    of = np.arange(n)
    _joined(of, got.column("row").to_numpy(), got.column("col").to_numpy())
    return of


def _by_component(a: Matrix, b: Matrix, of: np.ndarray, driver_elements: int, definite: bool = False) -> np.ndarray:
    n, extra, spark = a.rows, b.cols, a.spark
    order = np.argsort(of, kind="stable")
    heads, start, size = np.unique(of[order], return_index=True, return_counts=True)
    place, number = np.empty(n, np.int64), np.empty(n, np.int64)
    place[order], number[order] = np.arange(n) - np.repeat(start, size), np.repeat(np.arange(len(heads)), size)
    small = size * (size + extra) <= driver_elements
    # components are put together in bins of about a million elements
    bins = np.where(small, np.cumsum(np.where(small, size * (size + extra), 0)) // (1 << 20), -1)
    index = F.broadcast(spark.createDataFrame(pa.table({"row": np.arange(n), "bin": bins[number], "c": number, "at": place})))
    columns = index.select(F.col("row").alias("col"), F.col("at").alias("to"))
    cells = a.df.where("v <> 0").join(index, "row").join(columns, "col").select("bin", "c", "at", "to", F.col("v").cast("double").alias("v"))
    right = b.df.join(index, "row").select("bin", "c", "at", (-1 - F.col("col")).alias("to"), F.col("v").cast("double").alias("v"))

    def solved(table):
        c, at, to, v = (table.column(x).to_numpy() for x in ("c", "at", "to", "v"))
        order = np.argsort(c, kind="stable")
        c, at, to, v = c[order], at[order], to[order], v[order]
        edges = np.append(np.flatnonzero(np.append(True, c[1:] != c[:-1])), len(c))
        rows, found = [], []
        for lo, hi in zip(edges, edges[1:]):
            m = size[c[lo]]
            x = np.zeros((m, m + extra))
            i, j = at[lo:hi], to[lo:hi]
            x[i, np.where(j < 0, m - 1 - j, j)] = v[lo:hi]
            try:
                if definite:
                    _definite(x[:, :m])
                found.append(_eliminated(x, int(m)))
                rows.append(start[c[lo]] + np.arange(m))
            except Singular:  # told by a row that there is not
                rows, found = [np.array([-1])], [np.zeros((1, extra))]
                break
        return pa.table({"row": np.concatenate(rows), "values": pa.FixedSizeListArray.from_arrays(np.concatenate(found).ravel(), extra).cast(pa.list_(pa.float64()))})

    if np.any(np.bincount(number[_ids(a)], minlength=len(heads)) == 0):
        raise Singular("the matrix is singular")  # a component without elements
    out = np.zeros((n, extra))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = cells.where("bin >= 0").unionByName(right.where("bin >= 0")).repartition(tasks, "bin").groupBy("bin").applyInArrow(solved, "row long, values array<double>").toArrow()
    rows = got.column("row").to_numpy()
    if np.any(rows < 0):
        raise Singular("the matrix is singular")
    if len(rows):
        out[order[rows]] = got.column("values").combine_chunks().flatten().to_numpy().reshape(-1, extra)
    for k in np.flatnonzero(~small).tolist():
        own = cells.where(F.col("c") == k).select(F.col("at").alias("row"), F.col("to").alias("col"), "v")
        side = right.where(F.col("c") == k).select(F.col("at").alias("row"), (-1 - F.col("to")).alias("col"), "v")
        m = int(size[k])
        x = solve(Matrix(own, m, m, sparse=True), Matrix(side, m, extra, sparse=b.sparse), driver_elements, definite)
        out[order[start[k] : start[k] + m]] = x.to_numpy()
    return out


def _ids(a: Matrix) -> np.ndarray:
    """The rows that have an element other than 0."""
    return a.df.where("v <> 0").select("row").distinct().toArrow().column("row").to_numpy()


def _reduced(names: np.ndarray, factors: np.ndarray, head: np.ndarray, w: int, rest: int):
    """Rows less their multiples of the pivot rows, without the columns of the panel."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                row = batch.column("row").to_numpy()
                values = batch.column("values").flatten().to_numpy().reshape(-1, rest)[:, w:]
                yield products._row_arrays(row, values - factors[np.searchsorted(names, row)] @ head)

    return run


def _eliminated(x: np.ndarray, n: int) -> np.ndarray:
    """The solution of [A | B] at the driver."""
    for j in range(n):
        p = j + int(np.abs(x[j:, j]).argmax())
        if not abs(x[p, j]) >= PIVOT:
            raise Singular("the matrix is singular")
        x[[j, p]] = x[[p, j]]
        x[j + 1 :, j + 1 :] -= np.outer(x[j + 1 :, j] / x[j, j], x[j, j + 1 :])
    out = np.zeros((n, x.shape[1] - n))
    for j in range(n - 1, -1, -1):
        out[j] = (x[j, n:] - x[j, j + 1 : n] @ out[j + 1 :]) / x[j, j]
    return out
