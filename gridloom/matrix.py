"""Matrices as relations: a row for every element, for every stored one of a sparse matrix, or for every whole row or column."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A matrix with more elements than this is not taken to the driver.
DRIVER_ELEMENTS = 4_000_000
#: A vector with more rows than this is joined by shuffle instead of being broadcast.
BROADCAST_ROWS = 1_000_000

#: Elements of the longest row or column that is held as one array, and of the arrays that a task makes at once, about.
LANE, PIECE = 1 << 22, 1 << 20

#: Rows that a task groups, sorts or joins, about, where their number is known.
TASK_ROWS = 1 << 19

CELLS, BY_ROWS, BY_COLUMNS = "cells", "rows", "columns"


@dataclass(frozen=True, eq=False)
class Matrix:
    """A shape, which is kept apart as empty lanes leave no rows, and a `source` in one of three layouts.

    - `cells`: row, col (from 0) and v of every element.
    - `rows`: row and `values`, an array of the row's elements; `columns`: the same of columns, so
      that a transpose is only renamed.

    `element`, if given, is applied to every number of the source where it is read. Element-wise
    operators only compose it, and matrices made from one source are combined without a join.
    A sparse matrix (cells only) may lack elements, which count as zero in every operator. `stored`,
    if known, is the most elements it stores; what joins them makes more tasks where that is large.
    """

    source: DataFrame
    rows: int
    cols: int
    sparse: bool = False
    layout: str = CELLS
    element: Callable[[Column], Column] | None = None
    stored: int = 0

    def __post_init__(self):
        if self.rows < 0 or self.cols < 0:
            raise ValueError("dimensions must not be negative")
        if self.layout not in (CELLS, BY_ROWS, BY_COLUMNS) or (self.sparse and self.layout != CELLS):
            raise ValueError(f"no layout {self.layout!r} of a {'sparse' if self.sparse else 'dense'} matrix")

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows, self.cols

    @property
    def size(self) -> int:
        return self.rows * self.cols

    @property
    def spark(self) -> SparkSession:
        return self.source.sparkSession

    def _read(self, v: Column) -> Column:
        return self.element(v) if self.element else v

    @property
    def df(self) -> DataFrame:
        """(row, col, v), a projection of the source."""
        if self.layout == CELLS:
            return self.source.select("row", "col", self._read(F.col("v")).alias("v")) if self.element else self.source
        one, other = ("row", "col") if self.layout == BY_ROWS else ("col", "row")
        parts = self.source.select(F.col("row").alias("lane"), F.posexplode("values").alias("at", "v"))
        found = {one: F.col("lane"), other: F.col("at").cast("long")}
        return parts.select(found["row"].alias("row"), found["col"].alias("col"), self._read(F.col("v")).alias("v"))

    @staticmethod
    def zeros(spark: SparkSession, rows: int, cols: int) -> Matrix:
        return Matrix.filled(spark, rows, cols, 0.0)

    @staticmethod
    def filled(spark: SparkSession, rows: int, cols: int, value: float) -> Matrix:
        """All elements from one range of rows * cols numbers, so no join is needed."""
        if rows < 0 or cols < 0:
            raise ValueError("dimensions must not be negative")
        n = F.col("id")
        lin = spark.range(rows * cols)
        col = F.expr(f"id div {max(rows, 1)}")  # whole numbers: a quotient in double is wrong beyond 2^53
        return Matrix(lin.select((n % max(rows, 1)).alias("row"), col.alias("col"), F.lit(float(value)).alias("v")), rows, cols)

    @staticmethod
    def of(spark: SparkSession, values: np.ndarray | Iterable) -> Matrix:
        """A matrix that is at the driver."""
        a = np.asarray(values)
        a = a.astype(np.int64) if a.dtype.kind == "i" else a.astype(float)
        if a.ndim != 2:
            raise ValueError("a matrix has two dimensions")
        r, c = np.indices(a.shape)
        return Matrix(spark.createDataFrame(pa.table({"row": r.ravel(), "col": c.ravel(), "v": a.ravel()})), *a.shape)

    @staticmethod
    def from_arrays(df: DataFrame, row: str, values: str, rows: int, cols: int) -> Matrix:
        """From the row form: an array of `cols` numbers for each row number."""
        return Matrix(df.select(F.col(row).cast("long").alias("row"), F.col(values).cast("array<double>").alias("values")), rows, cols, layout=BY_ROWS)

    def map(self, f: Callable[[Column], Column], keeps_zero: bool = True) -> Matrix:
        """f of every element; a sparse matrix stays sparse if f(0) is 0 and is completed if not."""
        if self.sparse and not keeps_zero:
            return self.dense().map(f)
        inner = self.element
        return replace(self, element=(lambda v: f(inner(v))) if inner else f)

    def with_values(self, v) -> Matrix:
        """v, an expression of row, col and v, for every stored element."""
        return Matrix(self.df.select("row", "col", v.alias("v")), self.rows, self.cols, self.sparse, stored=self.stored)

    def fill(self, value: float) -> Matrix:
        return self.map(lambda _: F.lit(float(value)), keeps_zero=value == 0)

    def dense(self) -> Matrix:
        """All elements, absent ones as zeros."""
        if not self.sparse:
            return self
        kind = dict(self.df.dtypes)["v"]
        by_rows = self.cols <= LANE
        if kind in ("double", "bigint") and self.size and (by_rows or self.rows <= LANE):
            lane, at, lanes, length = ("row", "col", *self.shape) if by_rows else ("col", "row", self.cols, self.rows)
            cells = self.df.select(F.col(lane).alias("lane"), F.col(at).alias("at"), "v")
            own = self.spark.range(lanes).select(F.col("id").alias("lane"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast(kind).alias("v"))
            return Matrix(whole_lanes(cells.unionByName(own), length, kind, False), *self.shape, layout=BY_ROWS if by_rows else BY_COLUMNS)
        every = Matrix.zeros(self.spark, self.rows, self.cols).df.drop("v")
        return Matrix(every.join(self.df, ["row", "col"], "left").select("row", "col", F.coalesce("v", F.lit(0)).alias("v")), *self.shape)

    def _check(self, row: int, col: int) -> None:
        if not (0 <= row < self.rows and 0 <= col < self.cols):
            raise IndexError(f"element ({row}, {col}) of a {self.rows} x {self.cols} matrix")

    def get(self, row: int, col: int) -> float:
        self._check(row, col)
        if self.layout != CELLS:
            lane, at = (row, col) if self.layout == BY_ROWS else (col, row)
            return self.source.where(F.col("row") == lane).select(self._read(F.get("values", F.lit(at)))).first()[0]
        found = self.df.where((F.col("row") == row) & (F.col("col") == col)).first()
        return found["v"] if found else 0.0

    def set(self, row: int, col: int, value: float) -> Matrix:
        self._check(row, col)
        if self.sparse:
            others = self.df.where((F.col("row") != row) | (F.col("col") != col)).select("row", "col", "v")
            own = self.spark.range(1).select(F.lit(row).cast("long").alias("row"), F.lit(col).cast("long").alias("col"), F.lit(float(value)).alias("v"))
            return Matrix(others.unionByName(own), self.rows, self.cols, True)
        if self.layout != CELLS:
            lane, at = (row, col) if self.layout == BY_ROWS else (col, row)
            changed = F.transform("values", lambda v, i: F.when(i == at, F.lit(float(value))).otherwise(self._read(v)))
            values = F.when(F.col("row") == lane, changed).otherwise(F.transform("values", self._read))
            return replace(self, source=self.source.select("row", values.alias("values")), element=None)
        return self.with_values(F.when((F.col("row") == row) & (F.col("col") == col), F.lit(float(value))).otherwise(F.col("v")))

    def transpose(self) -> Matrix:
        if self.layout == CELLS:
            turned = self.source.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")
            return Matrix(turned, self.cols, self.rows, self.sparse, element=self.element, stored=self.stored)
        return replace(self, rows=self.cols, cols=self.rows, layout=BY_COLUMNS if self.layout == BY_ROWS else BY_ROWS)

    def __add__(self, other: Matrix | float) -> Matrix:
        from .operators import elementwise as e

        return e.add(self, other) if isinstance(other, Matrix) else e.scalar_add(self, other)

    def __sub__(self, other: Matrix | float) -> Matrix:
        from .operators import elementwise as e

        return e.sub(self, other) if isinstance(other, Matrix) else e.scalar_add(self, -other)

    def __mul__(self, alpha: float) -> Matrix:
        from .operators import elementwise as e

        return e.scalar_multiply(self, alpha)

    __radd__, __rmul__ = __add__, __mul__

    def __matmul__(self, other: Matrix) -> Matrix:
        from .operators import products

        return products.gemm(self, other)

    def row_arrays(self) -> DataFrame:
        """The row form (row, values) with every row and element: a projection of the source if that is in rows."""
        if self.layout == BY_ROWS:
            return self.source.select("row", F.transform("values", self._read).alias("values")) if self.element else self.source.select("row", "values")
        cells = F.collect_list(F.struct("col", "v"))
        if not self.sparse:
            return self.df.groupBy("row").agg(F.transform(F.array_sort(cells), lambda c: c["v"]).alias("values"))
        stored = self.df.groupBy("row").agg(F.map_from_entries(cells).alias("stored"))
        every = self.spark.range(self.rows).select(F.col("id").alias("row")).join(stored, "row", "left")
        places = F.sequence(F.lit(0).cast("long"), F.lit(self.cols - 1).cast("long")) if self.cols else F.array().cast("array<bigint>")
        return every.select("row", F.transform(places, lambda c: F.coalesce(F.col("stored")[c], F.lit(0.0))).alias("values"))

    def by_rows(self) -> Matrix:
        """This matrix in rows; shuffles its elements once if it is not already."""
        if self.layout == BY_ROWS:
            return self
        if not self.cols:
            raise ValueError("rows without elements have no row form")
        values = F.col("values").cast("array<double>").alias("values")
        return Matrix(self.row_arrays().select("row", values), *self.shape, layout=BY_ROWS)

    def to_numpy(self, most: int = DRIVER_ELEMENTS) -> np.ndarray:
        """The matrix at the driver; refused beyond `most` elements."""
        if self.size > most:
            raise ValueError(f"{self.rows} x {self.cols} elements are too many for the driver")
        out = np.zeros(self.shape)
        got = self.df.select("row", "col", F.col("v").cast("double")).toArrow()
        r, c, v = (got.column(i).to_numpy() for i in range(3))
        out[r, c] = v
        return out

    def same_shape(self, other: Matrix) -> None:
        if self.shape != other.shape:
            raise ValueError(f"shapes {self.shape} and {other.shape} differ")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt out by hash of the keys to tasks of about TASK_ROWS rows, if so many rows are too many for the session's shuffle partitions."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _lanes(batches, length: int, kind: np.dtype, forward: bool):
    """Arrays (row, values) of whole lanes from sorted (lane, at, v); a lane begins with offset -1."""
    open_ = None
    for batch in batches:
        if batch.num_rows:
            now = [batch.column("lane").to_numpy(), batch.column("at").to_numpy(), pc.fill_null(batch.column("v"), 0).to_numpy()]
            if open_:
                now = [np.concatenate(pair) for pair in zip(open_, now)]
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last lane may go on in the next batch
            yield from _filled([c[:cut] for c in now], length, kind, forward)
            open_ = [c[cut:] for c in now]
    if open_:
        yield from _filled(open_, length, kind, forward)


def _filled(cells: list[np.ndarray], length: int, kind: np.dtype, forward: bool):
    starts = np.append(np.flatnonzero(cells[1] < 0), len(cells[1]))
    most = max(1, PIECE // length)
    for k in range(0, len(starts) - 1, most):
        edge = starts[k : k + most + 1]
        lane, at, v = (c[edge[0] : edge[-1]] for c in cells)
        count = len(edge) - 1
        place = np.repeat(np.arange(count) * length, np.diff(edge)) + at
        if forward:  # each number holds behind its place, up to the next one's
            values = np.repeat(v, np.diff(np.append(place + 1, count * length)))
        else:
            values = np.zeros(count * length, kind)
            values[place[at >= 0]] = v[at >= 0]
        offsets = pa.array(np.arange(0, values.size + 1, length, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(lane[at < 0]), pa.ListArray.from_arrays(offsets, pa.array(values))], ["row", "values"])


def whole_lanes(cells: DataFrame, length: int, kind: str, forward: bool) -> DataFrame:
    """(row, values): an array of `length` numbers for each lane of cells (lane, at, v), each lane also with an offset -1.

    Places without a cell are 0; with `forward` each number stands at all places behind its own
    instead, up to that of the next one, and that at -1 from the first place on. Only cells are
    shuffled. A task holds the cells of one lane, and about PIECE numbers or one lane of arrays.
    """
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that few cells do not become few tasks
    dealt = cells.select("lane", "at", "v").repartition(n, "lane").sortWithinPartitions("lane", "at")
    numbers = np.dtype(np.float64 if kind == "double" else np.int64)
    return dealt.mapInArrow(lambda batches: _lanes(batches, length, numbers, forward), f"row long, values array<{kind}>")
