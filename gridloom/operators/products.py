"""Matrix products: sums within tasks, projections, tiles, and joins on the inner index where elements are sparse."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import BROADCAST_ROWS, BY_COLUMNS, BY_ROWS, CELLS, Matrix
from ..scratch import materialise

#: A matrix of at most so many elements (8 MB) is sent to every task, or kept there as a sum.
SMALL = 1 << 20
#: Products of pairs of elements that a task of a sparse product adds up, about, and those it makes at once.
TERMS, PIECE = 1 << 23, 1 << 20


def _index_grid(spark, rows: int, cols: int) -> DataFrame:
    return Matrix.zeros(spark, rows, cols).df


def _fits(a: Matrix, b: Matrix) -> None:
    if a.cols != b.rows:
        raise ValueError(f"inner dimensions {a.cols} and {b.rows} differ")


def gemm(a: Matrix, b: Matrix) -> Matrix:
    """C = A B; an inner dimension of 0 gives zeros.

    - Sparse operands are joined on the inner index; the product is sparse, as pairs that store
      nothing give no element. Where both are sparse and of doubles, see sparse_gemm().
    - A in columns and B in rows, such as AᵀA of the row form: every task adds up the products of
      the inner indices that it holds, and rows x cols sums are shuffled.
    - A in rows and a B of at most SMALL elements (or the other way round): a projection of the rows.
    - Otherwise tiles, see block_gemm().
    """
    _fits(a, b)
    if not a.cols:
        return Matrix.zeros(a.spark, a.rows, b.cols)
    if a.sparse and b.sparse and all(dict(m.df.dtypes)["v"] == "double" for m in (a, b)):
        return sparse_gemm(a, b)
    if a.sparse or b.sparse:
        left = a.df.select("row", F.col("col").alias("k"), F.col("v").alias("x"))
        right = b.df.select(F.col("row").alias("k"), "col", F.col("v").alias("y"))
        c = left.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
        return Matrix(c, a.rows, b.cols, sparse=True)
    if a.layout == BY_COLUMNS and b.layout == BY_ROWS and a.rows * b.cols <= SMALL:
        return _inner(a, b)
    if a.layout == BY_ROWS and b.size <= SMALL:
        return _times_small(a, b.to_numpy(SMALL))
    if b.layout == BY_COLUMNS and a.size <= SMALL:
        return _times_small(b.transpose(), a.to_numpy(SMALL).T).transpose()
    return block_gemm(a, b)


def sparse_gemm(a: Matrix, b: Matrix) -> Matrix:
    """C = A B of sparse matrices, by ranges of C's rows of about TERMS products of pairs each.

    Elements of A go to the range of their row, and a row of B to each range that has an element
    of A for it, so products are added up where they are made and are not shuffled. A row of more
    products is dealt out by a hash of the inner index; only the sums of such rows are shuffled.
    Indices may be of 32 bits, as keys of tables are; C keeps the types of A's rows and B's columns.
    """
    index = lambda c, name: F.col(c).cast("long").alias(name)
    left = materialise(a.df.select(index("row", "row"), index("col", "k"), F.col("v").alias("x")), "sparse-left")
    right = materialise(b.df.select(index("row", "k"), index("col", "col"), F.col("v").alias("y")), "sparse-right")
    width = max(1, -(-a.rows // 100_000))  # bands of rows, of which few reach the driver
    counts = left.join(right.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k").groupBy(F.expr(f"row div {width}").alias("band")).agg(F.sum("n").alias("n"))
    got = counts.orderBy("band").toArrow()
    band, work = got.column("band").to_numpy(), got.column("n").to_numpy().astype(np.int64)
    number, total, large = np.zeros(len(band), np.int64), 0, work > TERMS
    at = 0
    for i in range(len(band)):  # a large band is alone
        if i and (large[i] or large[i - 1] or total + work[i] > TERMS):
            at, total = at + 1, 0
        number[i] = at
        total += work[i]
    ways = np.where(large, -(-work // TERMS), 1)
    ranges = F.broadcast(a.spark.createDataFrame(pa.table({"band": band, "part": number, "ways": ways})))
    dealt = left.withColumn("band", F.expr(f"row div {width}")).join(ranges, "band")
    dealt = dealt.select("part", F.pmod(F.xxhash64("k"), "ways").alias("way"), "row", "k", "x")
    needed = dealt.select(F.col("part").alias("to"), F.col("way").alias("by"), F.col("k").alias("inner")).distinct()
    needed = needed.join(right, F.col("inner") == F.col("k")).select("to", "by", "inner", "col", "y")
    split = bool(large.any())

    def multiply(x, y):
        row, k, v = (x.column(c).to_numpy() for c in ("row", "k", "x"))
        inner, col, w = (y.column(c).to_numpy() for c in ("inner", "col", "y"))
        order = np.argsort(inner, kind="stable")
        inner, col, w = inner[order], col[order], w[order]
        start, end = np.searchsorted(inner, k), np.searchsorted(inner, k, "right")
        cols, place = np.unique(col, return_inverse=True)
        order = np.argsort(row, kind="stable")  # pieces are of neighbouring rows
        row, v, start, size = row[order], v[order], start[order], (end - start)[order]
        edges = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), PIECE), "right")
        keys, sums = np.zeros(0, np.int64), np.zeros(0)
        for lo, hi in zip(edges, np.append(edges[1:], len(row))):
            n = size[lo:hi]
            at = np.repeat(start[lo:hi] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            keys = np.append(keys, np.repeat(row[lo:hi] - row[0], n) * len(cols) + place[at])
            sums = np.append(sums, np.repeat(v[lo:hi], n) * w[at])
            keys, of = np.unique(keys, return_inverse=True)
            sums = np.bincount(of, sums, len(keys))
        first = row[0] if len(row) else 0
        return pa.table({"row": keys // max(len(cols), 1) + first, "col": cols[keys % max(len(cols), 1)], "v": sums})

    c = dealt.groupBy("part", "way").cogroup(needed.groupBy("to", "by")).applyInArrow(multiply, "row long, col long, v double")
    if split:
        c = c.groupBy("row", "col").agg(F.sum("v").alias("v"))
    kinds = {"row": dict(a.df.dtypes)["row"], "col": dict(b.df.dtypes)["col"]}
    return Matrix(c.select(*[F.col(x).cast(kind).alias(x) for x, kind in kinds.items()], "v"), a.rows, b.cols, sparse=True)


def _numbers(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float, copy=False)


def _row_arrays(rows: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(0, values.size + 1, max(values.shape[1], 1), dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(rows), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))], ["row", "values"])


def _inner(a: Matrix, b: Matrix) -> Matrix:
    """A B with both sides keyed by the inner index: outer products, added up in the task."""
    m, n = a.rows, b.cols
    if a.source is b.source:
        x, y = (F.transform("values", side.element) if side.element else F.col("values") for side in (a, b))
        pairs = a.source.select(x.alias("x"), y.alias("y")) if a.element or b.element else a.source.select(F.col("values").alias("x"))
    else:
        pairs = a.transpose().row_arrays().withColumnRenamed("values", "x").join(b.row_arrays().withColumnRenamed("values", "y"), "row").select("x", "y")
    other = "y" if "y" in pairs.columns else "x"

    def products(batches):
        total, seen = np.zeros((m, n)), False
        for batch in batches:
            if batch.num_rows:
                total += _numbers(batch, "x", m).T @ _numbers(batch, other, n)
                seen = True
        if seen:
            yield _row_arrays(np.arange(m), total)

    return Matrix(_summed(pairs.mapInArrow(products, "row long, values array<double>"), n), m, n, layout=BY_ROWS)


def _summed(parts: DataFrame, width: int) -> DataFrame:
    """(row, values): the sums of the arrays of each row, added up one after the other as they come sorted."""

    def add(batches):
        row, total = None, None
        for batch in batches:
            done, kept = [], []
            for r, x in zip(batch.column("row").to_pylist(), _numbers(batch, "values", width)):
                if r == row:
                    total = total + x
                    continue
                if row is not None:
                    done.append(row)
                    kept.append(total)
                row, total = r, x
            if done:
                yield _row_arrays(np.array(done), np.array(kept))
        if row is not None:
            yield _row_arrays(np.array([row]), total[None, :])

    return parts.repartition("row").sortWithinPartitions("row").mapInArrow(add, "row long, values array<double>")


def _times_small(a: Matrix, b: np.ndarray) -> Matrix:
    """The rows of A times a B that every task gets."""

    def multiply(batches):
        for batch in batches:
            if batch.num_rows:
                yield _row_arrays(batch.column("row").to_numpy(), _numbers(batch, "values", len(b)) @ b)

    return Matrix(a.row_arrays().mapInArrow(multiply, "row long, values array<double>"), a.rows, b.shape[1], layout=BY_ROWS)


def _tiles(m: Matrix, height: int, width: int, names: tuple[str, str], cell: str) -> DataFrame:
    """A row for each tile of height x width: its numbers, and pieces of the rows (or columns) in it, or its elements."""
    i, j = names
    if m.layout == CELLS:
        place = ((F.col("row") % height) * width + F.col("col") % width).cast("int")
        piece = F.struct(place.alias("at"), F.array(F.col("v").cast("double")).alias("v"))
        return m.df.groupBy(F.floor(F.col("row") / height).alias(i), F.floor(F.col("col") / width).alias(j)).agg(F.collect_list(piece).alias(cell))
    # pieces of lanes: a row of the source is cut, and its pieces are collected by tile
    length, along, across = (m.cols, width, height) if m.layout == BY_ROWS else (m.rows, height, width)
    values = F.transform("values", m.element) if m.element else F.col("values")
    cuts = F.sequence(F.lit(0).cast("long"), F.lit(-(-length // along) - 1).cast("long"))
    cut = m.source.select("row", values.alias("values"), F.explode(cuts).alias("part"))
    cut = cut.select("row", "part", F.slice("values", (F.col("part") * along + 1).cast("int"), F.lit(along)).alias("v"))
    piece = F.struct((F.col("row") % across).cast("int").alias("at"), "v")
    lane = F.floor(F.col("row") / across)
    keys = (lane.alias(i), F.col("part").alias(j)) if m.layout == BY_ROWS else (F.col("part").alias(i), lane.alias(j))
    return cut.groupBy(*keys).agg(F.collect_list(piece).alias(cell))


def _tile(cells: pa.StructArray, layout: str, height: int, width: int) -> np.ndarray:
    """One tile as an array, from what _tiles() collected."""
    tile, at = np.zeros((height, width)), cells.field("at").to_numpy()
    lists = cells.field("v")
    numbers = lists.flatten().to_numpy(zero_copy_only=False)
    if layout == CELLS:
        tile.ravel()[at] = numbers
        return tile
    numbers = numbers.reshape(len(at), -1)
    if layout == BY_ROWS:
        tile[at, : numbers.shape[1]] = numbers
    else:
        tile[: numbers.shape[1], at] = numbers.T
    return tile


def block_gemm(a: Matrix, b: Matrix, size: int = 256, depth: int = 1024) -> Matrix:
    """C = A B of dense matrices over a grid of tiles: size x depth of A and depth x size of B.

    Elements are shuffled once to make tiles; each tile of A goes to every block column of C and
    each tile of B to every block row, where a task multiplies one pair at a time, so neither the
    inner dimension nor a block row ever lies in one task. Products with the same place in C are
    added up as whole rows of tiles.
    """
    _fits(a, b)
    a, b = a.dense(), b.dense()
    if not a.cols:
        return Matrix.zeros(a.spark, a.rows, b.cols)
    rows, cols = a.rows, b.cols
    height, width, depth = min(size, max(rows, 1)), min(size, max(cols, 1)), min(depth, a.cols)
    down, across, deep = -(-rows // height), -(-cols // width), -(-a.cols // depth)
    count = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = _tiles(a, height, depth, ("bi", "bk"), "x").select("bi", "bk", "x", count(across).alias("bj"))
    right = _tiles(b, depth, width, ("bk", "bj"), "y").select("bk", "bj", "y", count(down).alias("bi"))
    kinds = a.layout, b.layout

    def multiply(x, y):
        schema = pa.schema([("bj", pa.int64()), ("row", pa.int64()), ("values", pa.list_(pa.float64()))])
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        bi, bj = x.column("bi")[0].as_py(), x.column("bj")[0].as_py()
        c = _tile(x.column("x")[0].values, kinds[0], height, depth) @ _tile(y.column("y")[0].values, kinds[1], depth, width)
        c = c[: rows - bi * height]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, width, dtype=np.int32)), pa.array(c.ravel()))
        return pa.Table.from_arrays([pa.array(np.full(len(c), bj)), pa.array(np.arange(len(c)) + bi * height), lists], schema=schema)

    keys = ("bi", "bj", "bk")
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiply, "bj long, row long, values array<double>")
    if across == 1:
        parts = parts.select("row", "values")
        return Matrix(parts if deep == 1 else _summed(parts, width), rows, cols, layout=BY_ROWS)
    wide = parts.select((F.col("row") * across + F.col("bj")).alias("row"), "values")  # a number for each piece of a row
    wide = wide if deep == 1 else _summed(wide, width)
    cells = wide.select(F.expr(f"row div {across}").alias("r"), (F.col("row") % across).alias("bj"), F.posexplode("values").alias("at", "v"))
    cells = cells.select(F.col("r").alias("row"), (F.col("bj") * width + F.col("at")).alias("col"), "v")
    return Matrix(cells.where(F.col("col") < cols) if cols % width else cells, rows, cols)


def gram(a: Matrix) -> Matrix:
    """AᵀA of a tall matrix: every task multiplies the rows it holds, and cols x cols sums are shuffled.

    A task keeps one cols x cols block. Of the row form nothing else moves. A sparse matrix is
    joined with itself on the row, and its product is sparse.
    """
    if a.sparse:
        return gemm(a.transpose(), a)
    a = a.by_rows()
    return _inner(a.transpose(), a)


def _vector_side(x: DataFrame, n: int) -> DataFrame:
    return F.broadcast(x) if n <= BROADCAST_ROWS else x


def spmv(a: Matrix, x: DataFrame) -> DataFrame:
    """y = A x of a sparse A (stored elements only) and a vector (row, v) of a.cols rows; rows without elements give 0.

    The vector is broadcast up to BROADCAST_ROWS rows and joined by shuffle beyond.
    """
    right = _vector_side(x.select(F.col("row").alias("col"), F.col("v").alias("w")), a.cols)
    y = a.df.join(right, "col").groupBy("row").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    every = a.spark.range(a.rows).select(F.col("id").alias("row"))
    return every.join(y, "row", "left").select("row", F.coalesce("v", F.lit(0.0)).alias("v"))


def spmm(a: Matrix, b: Matrix) -> Matrix:
    """Y = A B of a sparse A and a dense B; elements without terms are 0."""
    if a.cols != b.rows:
        raise ValueError(f"inner dimensions {a.cols} and {b.rows} differ")
    left = a.df.select("row", F.col("col").alias("k"), F.col("v").alias("x"))
    right = b.df.select(F.col("row").alias("k"), "col", F.col("v").alias("y"))
    right = F.broadcast(right) if b.size <= BROADCAST_ROWS else right
    y = left.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    every = _index_grid(a.spark, a.rows, b.cols).drop("v")
    return Matrix(every.join(y, ["row", "col"], "left").select("row", "col", F.coalesce("v", F.lit(0.0)).alias("v")), a.rows, b.cols)
