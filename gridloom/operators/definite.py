"""Cholesky solves of large sparse matrices of blocks that are symmetric and positive definite, by component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..scratch import drop_folders, folders_of, materialise
from . import products
from .dense import Singular, _components

#: The most unknowns of a component, whose square (134 MB) one task holds, and of the border, whose square the driver holds.
SIDE, BORDER = 4096, 2000
#: Rows and columns that are changed at once.
STRIP = 256


def factor(a: np.ndarray) -> None:
    """The lower Cholesky factor in the lower triangle of a, in place; Singular if a is not positive definite."""
    n = len(a)
    for at in range(0, n, STRIP):
        end = min(at + STRIP, n)
        try:
            own = np.linalg.cholesky(a[at:end, at:end])
        except np.linalg.LinAlgError:
            raise Singular("the matrix is not positive definite") from None
        if not np.isfinite(own).all():
            raise Singular("the matrix is not positive definite")
        a[at:end, at:end] = own
        a[end:, at:end] = np.linalg.solve(own, a[end:, at:end].T).T
        for low in range(end, n, STRIP):
            a[low : low + STRIP, end : low + STRIP] -= a[low : low + STRIP, at:end] @ a[end : low + STRIP, at:end].T


def substitute(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with L Lᵀ x = b; only the lower triangle of `low` is read."""
    x, n = b.copy(), len(b)
    edges = range(0, n, STRIP)
    for at in edges:
        end = at + STRIP
        x[at:end] = np.linalg.solve(np.tril(low[at:end, at:end]), x[at:end] - low[at:end, :at] @ x[:at])
    for at in reversed(edges):
        end = at + STRIP
        x[at:end] = np.linalg.solve(np.tril(low[at:end, at:end]).T, x[at:end] - low[end:, at:end].T @ x[end:])
    return x


def solve_definite(blocks: DataFrame, count: int, size: int, b: np.ndarray) -> np.ndarray | None:
    """x with A x = b, of a symmetric A of count x count blocks (i, j, values) with i >= j; None if no task could hold a component.

    Components, found from the blocks, are each factored in one task. Where one is too large, blocks
    that are linked with over twice as many others as the median are taken for a border: what is left
    of A falls apart, each component is solved for its columns towards the border as well, and the
    driver solves for the border. Singular is raised if A is not positive definite.
    """
    spark = blocks.sparkSession
    of = _components(_links(blocks, count))
    border = np.zeros(0, np.int64)
    if np.bincount(of).max() * size > SIDE:
        ends = blocks.where("i <> j").select("i").unionByName(blocks.where("i <> j").select(F.col("j").alias("i")))
        got = ends.groupBy("i").agg(F.count(F.lit(1)).alias("n")).toArrow()
        degree = np.zeros(count, np.int64)
        degree[got.column("i").to_numpy()] = got.column("n").to_numpy()
        border = np.flatnonzero(degree > 2 * np.median(degree))
        if not len(border) or len(border) * size > BORDER:
            return None
        inside = spark.createDataFrame(pa.table({"b": border}))
        rest = blocks
        for end in "ij":
            rest = rest.join(F.broadcast(inside), F.col(end) == F.col("b"), "left_anti")
        of = _components(_links(rest, count))
    k = len(border) * size
    order = np.argsort(of, kind="stable")
    order = order[~np.isin(order, border)]
    heads, start, many = np.unique(of[order], return_index=True, return_counts=True)
    if len(many) and many.max() * size > SIDE:
        return None
    # a component's number, -1 of the border, and the place in it
    number, place = np.full(count, -1), np.zeros(count, np.int64)
    number[order], place[order] = np.repeat(np.arange(len(heads)), many), np.arange(len(order)) - np.repeat(start, many)
    place[border] = np.arange(len(border))
    index = spark.createDataFrame(pa.table({"i": np.arange(count), "c": number, "at": place}))
    one = F.broadcast(index)
    two = F.broadcast(index.withColumnsRenamed({"i": "j", "c": "d", "at": "to"}))
    cells = blocks.join(one, "i").join(two, "j").select("c", "at", "d", "to", "values")
    sent = spark.sparkContext.broadcast((b.reshape(count, size), order, start, many))

    def solved(batches):
        right, order, start, many = sent.value
        total, one = np.zeros((k, k + 1)), None

        def opened(c):
            m = int(many[c])
            ids = order[start[c] : start[c] + m]
            w = np.zeros((m * size, k + 1))
            w[:, k] = right[ids].ravel()
            return c, ids, np.zeros((m * size, m * size)), w

        def closed(ids, a, w):
            cross = w[:, :k].copy()
            factor(a)
            z = substitute(a, w)
            np.add(total, cross.T @ z, out=total)
            rows = (ids[:, None] * size + np.arange(size)).ravel()
            return products._row_arrays(rows, z)

        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                c, at, d, to = (batch.column(x).to_numpy() for x in ("c", "at", "d", "to"))
                values = batch.column("values").flatten().to_numpy().reshape(-1, size, size)
                edges = np.append(np.flatnonzero(np.append(True, c[1:] != c[:-1])), len(c))
                for lo, hi in zip(edges, edges[1:]):
                    if one is None or one[0] != c[lo]:
                        if one is not None:
                            yield closed(*one[1:])
                        one = opened(int(c[lo]))
                    _, _, a, w = one
                    i, j, v, own = at[lo:hi], to[lo:hi], values[lo:hi], d[lo:hi] >= 0
                    a.reshape(-1, size, a.shape[1] // size, size)[i[own], :, j[own], :] = v[own]
                    if not own.all():
                        w.reshape(-1, size, k + 1)[i[~own, None, None], np.arange(size)[:, None], j[~own, None, None] * size + np.arange(size)] = v[~own]
            if one is not None:
                yield closed(*one[1:])
            if k and total.any():
                yield products._row_arrays(-1 - np.arange(k), total)
        except Singular:  # told by a row that there is not
            yield products._row_arrays(np.array([count * size]), np.zeros((1, k + 1)))

    # of a block towards the border, in either triangle, the side that is in a component comes first
    turned = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda e: F.get("values", (e % size * size + F.floor(e / size)).cast("int")))
    within = cells.where("c >= 0 AND (c = d OR d < 0)").select("c", "at", "d", "to", "values")
    if k:
        within = within.unionByName(cells.where("c < 0 AND d >= 0").select(F.col("d").alias("c"), F.col("to").alias("at"), F.lit(-1).cast("long").alias("d"), F.col("at").alias("to"), turned.alias("values")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(heads), 1000))
    dealt = within.repartition(tasks, "c").sortWithinPartitions("c")
    found = materialise(dealt.mapInArrow(solved, "row long, values array<double>"), "definite")
    sent.unpersist()
    if found.where(F.col("row") == count * size).limit(1).count():
        raise Singular("the matrix is not positive definite")
    x = np.zeros(count * size)
    known = np.zeros(k)
    if k:
        at = (border[:, None] * size + np.arange(size)).ravel()
        square = np.column_stack([np.zeros((k, k)), b[at]])
        got = cells.where("c < 0 AND d < 0").select("at", "to", "values").toArrow()
        i, j = got.column("at").to_numpy(), got.column("to").to_numpy()
        own = np.zeros((len(border), size, len(border), size))
        own[i, :, j, :] = got.column("values").combine_chunks().flatten().to_numpy().reshape(-1, size, size)
        square[:, :k] = own.reshape(k, k)
        # what lies above the diagonal in the order of the border is not read
        sums = products._summed(found.where("row < 0"), k + 1).toArrow()
        rows = -1 - sums.column("row").to_numpy()
        square[rows] -= sums.column("values").combine_chunks().flatten().to_numpy().reshape(-1, k + 1)
        low = square[:, :k].copy()
        factor(low)
        known = substitute(low, square[:, k:])[:, 0]
        x[at] = known

    def less(batches):
        for batch in batches:
            if batch.num_rows:
                z = batch.column("values").flatten().to_numpy().reshape(-1, k + 1)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(z[:, k] - z[:, :k] @ known)], ["row", "v"])

    got = found.where("row >= 0").mapInArrow(less, "row long, v double").toArrow()
    x[got.column("row").to_numpy()] = got.column("v").to_numpy()
    drop_folders(spark, folders_of(found))
    return x


def _links(blocks: DataFrame, count: int) -> Matrix:
    return Matrix(blocks.where("i <> j").select(F.col("i").alias("row"), F.col("j").alias("col"), F.lit(1.0).alias("v")), count, count, sparse=True)
