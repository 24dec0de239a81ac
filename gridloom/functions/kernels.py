"""Small dense kernels over batches: numpy on arrays whose first axis counts the systems."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Order of the six numbers of a symmetric 3 x 3 matrix: xx, xy, xz, yy, yz, zz.
COMPACT = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def unpack_symmetric(c: np.ndarray) -> np.ndarray:
    a = np.empty((len(c), 3, 3))
    for k, (i, j) in enumerate(COMPACT):
        a[:, i, j] = a[:, j, i] = c[:, k]
    return a


def _rotate(a: np.ndarray, v: np.ndarray, p: int, q: int) -> None:
    """One Jacobi rotation for every matrix that has an element at (p, q)."""
    off = a[:, p, q]
    live = off != 0
    with np.errstate(all="ignore"):
        tau = (a[:, q, q] - a[:, p, p]) / (2 * off)
        t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.sqrt(1 + np.minimum(np.abs(tau), 1e150) ** 2))
    t = np.where(live & np.isfinite(t), t, 0.0)
    c = 1 / np.sqrt(1 + t * t)
    s = t * c
    for m in (a, a.transpose(0, 2, 1)):  # columns, then rows
        mp, mq = m[:, :, p].copy(), m[:, :, q].copy()
        m[:, :, p], m[:, :, q] = c[:, None] * mp - s[:, None] * mq, s[:, None] * mp + c[:, None] * mq
    a[:, p, q] = a[:, q, p] = np.where(live, 0.0, a[:, p, q])
    vp, vq = v[:, :, p].copy(), v[:, :, q].copy()
    v[:, :, p], v[:, :, q] = c[:, None] * vp - s[:, None] * vq, s[:, None] * vp + c[:, None] * vq


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _fixed_basis(others: np.ndarray, taken: int) -> np.ndarray:
    """For each system `taken` unit vectors orthogonal to `others` (n, k, 3), from the axes in order.

    Each axis is projected onto what is left, twice for accuracy; the first axes whose
    projection is long enough are taken.
    """
    n = len(others)
    known = [others[:, k] for k in range(others.shape[1])]
    out = np.zeros((n, taken, 3))
    count = np.zeros(n, int)
    for axis in np.eye(3):
        x = np.tile(axis, (n, 1))
        for _ in range(2):
            for u in [*known, *[out[:, k] for k in range(taken)]]:
                x = x - (x * u).sum(axis=1, keepdims=True) * u
        use = (np.linalg.norm(x, axis=1) > 64 * EPS) & (count < taken)
        unit = _unit(x)
        for k in range(taken):
            at = use & (count == k)
            out[at, k] = unit[at]
        count += use
    return out


def eigh3(c: np.ndarray, sweeps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (n, 3), ascending, and eigenvectors (n, 3, 3) as columns, of symmetric 3 x 3 matrices in compact form.

    Cyclic Jacobi after scaling by the largest magnitude. The component of largest magnitude of
    each vector is not negative (the first of equals decides). Eigenvalues that agree within
    256 eps of their size share a space, whose basis comes from the coordinate axes, so that it
    does not depend on rounding.
    """
    c = np.asarray(c, float).reshape(-1, 6)
    top = np.abs(c).max(axis=1, initial=0)
    scale = np.where(top > 0, top, 1.0)
    a = unpack_symmetric(c / scale[:, None])
    v = np.tile(np.eye(3), (len(c), 1, 1))
    for _ in range(sweeps):
        for p, q in ((0, 1), (0, 2), (1, 2)):
            _rotate(a, v, p, q)
    w = np.einsum("nii->ni", a)
    order = np.argsort(w, axis=1, kind="stable")
    w = np.take_along_axis(w, order, axis=1)
    v = np.take_along_axis(v, order[:, None, :], axis=2)
    with np.errstate(over="ignore"):
        values = w * scale[:, None]
    close = lambda i, j: np.abs(w[:, i] - w[:, j]) <= 256 * EPS * np.maximum(1 / np.maximum(scale, 1e-300), np.maximum(np.abs(w[:, i]), np.abs(w[:, j])))
    low, high = close(0, 1), close(1, 2)
    every = low & high
    if every.any():
        v[every] = np.eye(3)
    for pair, alone in ((low & ~high, 2), (high & ~low, 0)):
        if pair.any():
            single = _unit(v[pair][:, :, alone])
            two = _fixed_basis(single[:, None, :], 2)
            columns = [two[:, 0], two[:, 1], single] if alone == 2 else [single, two[:, 0], two[:, 1]]
            v[pair] = np.stack(columns, axis=2)
    largest = np.abs(v)
    first = (largest >= largest.max(axis=1, keepdims=True) * (1 - 4 * EPS)).argmax(axis=1)
    sign = np.take_along_axis(v, first[:, None, :], axis=1)
    return values, np.where(sign < 0, -v, v)


def svd3(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, s (descending), vt of row-major 3 x 3 matrices (n, 9), through the eigenvectors of the normal matrix.

    Columns of u for singular values that are not above max(1, s) * 128 eps are completed from the axes.
    """
    a = np.asarray(m, float).reshape(-1, 3, 3)
    top = np.abs(a).max(axis=(1, 2), initial=0)
    scale = np.where(top > 0, top, 1.0)
    b = a / scale[:, None, None]
    normal = np.einsum("nki,nkj->nij", b, b)
    _, v = eigh3(np.stack([normal[:, i, j] for i, j in COMPACT], axis=1))
    v = v[:, :, ::-1]
    u_raw = b @ v
    s = np.linalg.norm(u_raw, axis=1)
    order = np.argsort(-s, axis=1, kind="stable")
    s = np.take_along_axis(s, order, axis=1)
    v = np.take_along_axis(v, order[:, None, :], axis=2)
    u_raw = np.take_along_axis(u_raw, order[:, None, :], axis=2)
    u = np.zeros_like(a)
    for k in range(3):
        x = u_raw[:, :, k]
        for _ in range(2):
            for j in range(k):
                x = x - (x * u[:, :, j]).sum(axis=1, keepdims=True) * u[:, :, j]
        good = np.linalg.norm(x, axis=1) > np.maximum(1 / scale, s[:, 0]) * 128 * EPS
        u[good, :, k] = _unit(x)[good]
        if (~good).any():
            u[~good, :, k] = _fixed_basis(np.stack([u[~good][:, :, j] for j in range(k)], axis=1) if k else np.zeros(((~good).sum(), 0, 3)), 1)[:, 0]
    return u, s * scale[:, None], v.transpose(0, 2, 1)


def solve_small(a: np.ndarray, b: np.ndarray, tolerance: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(x, ok) of a[i] x = b[i] by elimination with row scaling and partial pivoting, all systems side by side.

    A system is not ok if it is singular to `tolerance` (16 n eps) of its scaled rows, or not finite.
    """
    n, k = b.shape
    limit = 16 * k * EPS if tolerance is None else tolerance
    m = np.concatenate([a.reshape(n, k, k), b[:, :, None]], axis=2).astype(float)
    ok = np.isfinite(m).all(axis=(1, 2))
    m[~ok] = np.concatenate([np.eye(k), np.zeros((k, 1))], axis=1)
    top = np.abs(m[:, :, :k]).max(axis=2)
    ok &= (top > 0).all(axis=1)
    m /= np.where(top > 0, top, 1.0)[:, :, None]
    every = np.arange(n)
    for j in range(k):
        best = j + np.abs(m[:, j:, j]).argmax(axis=1)
        m[every, j], m[every, best] = m[every, best].copy(), m[every, j].copy()
        pivot = m[:, j, j].copy()
        good = np.abs(pivot) > limit
        ok &= good
        pivot[~good] = 1.0
        for i in range(j + 1, k):
            m[:, i, :] -= (m[:, i, j] / pivot)[:, None] * m[:, j, :]
    x = np.zeros((n, k))
    for j in range(k - 1, -1, -1):
        pivot = np.where(np.abs(m[:, j, j]) > limit, m[:, j, j], 1.0)
        x[:, j] = (m[:, j, k] - (m[:, j, j + 1 : k] * x[:, j + 1 :]).sum(axis=1)) / pivot
    ok &= np.isfinite(x).all(axis=1)
    return x, ok


def spd_inverse(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inverse, ok) of symmetric positive definite matrices (n, k, k); those that are not are not ok."""
    a = np.asarray(a, float)
    n, k, _ = a.shape
    ok = np.isfinite(a).all(axis=(1, 2))
    low = np.zeros_like(a)
    for j in range(k):
        rest = a[:, j, j] - (low[:, j, :j] ** 2).sum(axis=1)
        ok &= rest > 0
        low[:, j, j] = np.sqrt(np.where(rest > 0, rest, 1.0))
        for i in range(j + 1, k):
            low[:, i, j] = (a[:, i, j] - (low[:, i, :j] * low[:, j, :j]).sum(axis=1)) / low[:, j, j]
    inverse = np.zeros_like(a)
    good = np.flatnonzero(ok)
    if len(good):
        half = np.linalg.solve(low[good], np.tile(np.eye(k), (len(good), 1, 1)))
        inverse[good] = np.einsum("nki,nkj->nij", half, half)
    return inverse, ok
