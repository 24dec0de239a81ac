"""Conjugate gradients for sparse symmetric positive definite systems.

The matrix stays distributed; each iteration is one product and a few sums. Vectors of up to
DRIVER_ROWS rows live at the driver and travel to the product as a broadcast table. Longer
ones are tables bucketed like the matrix, made by one write in every iteration: see cg_tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import EPSILON
from ..matrix import BROADCAST_ROWS, Matrix
from ..scratch import drop_folders, folders_of, materialise
from . import cg_tables
from .products import spmv

DRIVER_ROWS = 1_000_000


@dataclass(frozen=True)
class SolverOptions:
    max_iterations: int = 1000
    relative_tolerance: float = 1e-6
    absolute_tolerance: float = 0.0
    jacobi: bool = True
    require_convergence: bool = False

    def __post_init__(self):
        if self.max_iterations < 0:
            raise ValueError("max_iterations must not be negative")
        if not (math.isfinite(self.relative_tolerance) and 0 <= self.relative_tolerance <= 1):
            raise ValueError("relative_tolerance must lie in [0, 1]")
        if not (math.isfinite(self.absolute_tolerance) and self.absolute_tolerance >= 0):
            raise ValueError("absolute_tolerance must not be negative")


@dataclass(frozen=True)
class SolverReport:
    converged: bool
    iterations: int
    initial_residual_norm: float
    final_residual_norm: float

    def as_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.converged, self.iterations, self.initial_residual_norm, self.final_residual_norm)],
            "converged boolean, iterations int, initial_residual_norm double, final_residual_norm double",
        )


class Breakdown(RuntimeError):
    """The matrix is not positive definite along a search direction, or a number is not finite."""


class DriverVectors:
    """Vectors as numpy arrays at the driver."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n = spark, n

    def load(self, x: DataFrame | np.ndarray | None) -> np.ndarray:
        out = np.zeros(self.n)
        if isinstance(x, np.ndarray):
            out[:] = x
        elif x is not None:
            got = x.select(F.col("row").cast("long"), F.col("v").cast("double")).toArrow()
            out[got.column(0).to_numpy()] = got.column(1).to_numpy()
        return out

    def frame(self, x: np.ndarray) -> DataFrame:
        table = pa.table({"row": np.arange(self.n), "v": np.asarray(x, float)})
        return self.spark.createDataFrame(table)

    @staticmethod
    def held(cells: DataFrame) -> DataFrame:
        """The elements of a matrix, kept by row, so that a product is added up where they lie; a row has at most DRIVER_ROWS columns."""
        return cells.select("row", "col", "v").repartition("row").persist(StorageLevel.MEMORY_AND_DISK)

    def apply(self, a: Matrix, x: np.ndarray) -> np.ndarray:
        right = self.frame(x).select(F.col("row").alias("col"), F.col("v").alias("w"))
        y = a.df.join(F.broadcast(right), "col").groupBy("row").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
        return self.load(y)

    def dot(self, x: np.ndarray, y: np.ndarray) -> float:
        return float(x @ y)

    def axpy(self, alpha: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return alpha * x + y

    def settle(self, *vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        return vectors

    def keep_only(self, *vectors: np.ndarray) -> None:
        pass


class TableVectors:
    """Vectors as tables (row, v) with a row for every index."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n = spark, n
        self.made: set[str] = set()

    def load(self, x: DataFrame | None) -> DataFrame:
        every = self.spark.range(self.n).select(F.col("id").alias("row"))
        if x is None:
            return every.withColumn("v", F.lit(0.0))
        return every.join(x.select("row", F.col("v").cast("double").alias("v")), "row", "left").select("row", F.coalesce("v", F.lit(0.0)).alias("v"))

    def frame(self, x: DataFrame) -> DataFrame:
        return x

    def apply(self, a: Matrix, x: DataFrame) -> DataFrame:
        return self._written(spmv(a, x), "product")

    def _written(self, x: DataFrame, name: str) -> DataFrame:
        x = materialise(x, name)
        self.made |= folders_of(x)
        return x

    def keep_only(self, *vectors: DataFrame) -> None:
        """Delete what was written here and none of these vectors reads."""
        kept = set().union(*map(folders_of, vectors))
        drop_folders(self.spark, self.made - kept)
        self.made &= kept

    def _both(self, x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(y.select("row", F.col("v").alias("w")), "row")

    def dot(self, x: DataFrame, y: DataFrame) -> float:
        return float(self._both(x, y).agg(F.sum(F.col("v") * F.col("w"))).first()[0] or 0.0)

    def axpy(self, alpha: float, x: DataFrame, y: DataFrame) -> DataFrame:
        return self._both(x, y).select("row", (F.lit(float(alpha)) * F.col("v") + F.col("w")).alias("v"))

    def settle(self, *vectors: DataFrame) -> tuple[DataFrame, ...]:
        return tuple(self._written(v, "vector") for v in vectors)


def vectors_for(spark: SparkSession, n: int, driver_rows: int = DRIVER_ROWS):
    return DriverVectors(spark, n) if n <= min(driver_rows, BROADCAST_ROWS) else TableVectors(spark, n)


def conjugate_gradients(space, apply, b, x, precondition, options: SolverOptions, sum_of_tolerances: bool = False, fixed: int | None = None):
    """Returns (x, report). `apply` is the operator and `precondition` maps a residual, or is None.

    Stops when the residual is within max(absolute, relative * first residual), or within their
    sum. With `fixed` that many steps are made without looking at the residual; a direction of
    zero then makes a step of zero.
    """
    r = space.axpy(-1.0, apply(x), b)
    first = math.sqrt(max(space.dot(r, r), 0.0))
    relative = options.relative_tolerance * first
    limit = options.absolute_tolerance + relative if sum_of_tolerances else max(options.absolute_tolerance, relative)
    norm, done = first, 0
    if not math.isfinite(first):
        raise Breakdown("the first residual is not finite")
    steps = options.max_iterations if fixed is None else fixed
    if steps and (fixed is not None or norm > limit):
        z = precondition(r) if precondition else r
        p, rho = z, space.dot(r, z)
        for _ in range(steps):
            q = apply(p)
            curve = space.dot(p, q)
            if fixed is not None and rho == 0 and curve == 0:
                alpha = 0.0
            elif not (math.isfinite(curve) and curve > 0):
                raise Breakdown(f"p'Ap is {curve} in iteration {done + 1}")
            else:
                alpha = rho / curve
            x, r = space.settle(space.axpy(alpha, p, x), space.axpy(-alpha, q, r))
            done += 1
            if fixed is None:
                norm = math.sqrt(max(space.dot(r, r), 0.0))
                if not math.isfinite(norm):
                    raise Breakdown("the residual is not finite")
                if norm <= limit:
                    break
            z = precondition(r) if precondition else r
            new = space.dot(r, z)
            beta, rho = (new / rho if rho else 0.0), new
            (p,) = space.settle(space.axpy(beta, p, z))
            space.keep_only(x, r, p)
        if fixed is not None:
            norm = math.sqrt(max(space.dot(r, r), 0.0))
    space.keep_only(x)
    return x, SolverReport(norm <= limit, done, first, norm)


def inverse_diagonal(a: Matrix) -> Matrix:
    """The inverse of the diagonal, equal positions summed; ValueError names the first row whose diagonal is missing or tiny."""
    cells = a.df.groupBy("row", "col").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("row").agg(F.max(F.when(F.col("row") == F.col("col"), F.col("v"))).alias("d"), F.max(F.abs("v")).alias("top"))
    rows = a.spark.range(a.rows).select(F.col("id").alias("row")).join(rows, "row", "left")
    bad = rows.where(F.col("d").isNull() | ~(F.col("d") > 16 * EPSILON * F.col("top"))).agg(F.min("row")).first()[0]
    if bad is not None:
        raise ValueError(f"row {bad} has no usable diagonal")
    return Matrix(rows.select("row", F.col("row").alias("col"), (1 / F.col("d")).alias("v")), a.rows, a.cols)


def block_diagonal(spark: SparkSession, blocks: DataFrame | np.ndarray, n: int) -> Matrix:
    """A block-diagonal matrix from (block, values), values row-major, or from an array (k, size, size)."""
    if isinstance(blocks, np.ndarray):
        table = [(i, b.ravel().tolist()) for i, b in enumerate(blocks.astype(float))]
        blocks = spark.createDataFrame(table, "block bigint, values array<double>")
    size = F.sqrt(F.size("values")).cast("long")
    cells = blocks.select("block", size.alias("size"), F.posexplode("values").alias("at", "v"))
    row = F.col("block") * F.col("size") + F.floor(F.col("at") / F.col("size"))
    return Matrix(cells.select(row.alias("row"), (F.col("block") * F.col("size") + F.col("at") % F.col("size")).alias("col"), "v"), n, n)


def _check(a: Matrix) -> None:
    if a.rows != a.cols:
        raise ValueError("the matrix is not square")


def _solve(a: Matrix, b, x0, preconditioner: Matrix | None, options: SolverOptions, fixed: int | None, driver_rows: int, diagonal: bool = False):
    _check(a)
    space = vectors_for(a.spark, a.rows, driver_rows)
    if isinstance(space, TableVectors):
        try:
            x, told = cg_tables.solve(a, b, x0, preconditioner, diagonal, options, fixed)
        except ArithmeticError as e:
            raise Breakdown(str(e)) from e
        return x, _required(SolverReport(*told), options)
    held = Matrix(space.held(a.df), a.rows, a.cols)
    m = preconditioner and Matrix(space.held(preconditioner.df), a.rows, a.cols)
    try:
        x, report = conjugate_gradients(
            space, lambda p: space.apply(held, p), space.load(b), space.load(x0), m and (lambda r: space.apply(m, r)), options, fixed=fixed
        )
    finally:
        held.df.unpersist()
        if m:
            m.df.unpersist()
    return space.frame(x), _required(report, options)


def _required(report: SolverReport, options: SolverOptions) -> SolverReport:
    if options.require_convergence and not report.converged:
        raise RuntimeError(f"no convergence in {report.iterations} iterations")
    return report


def cg(a: Matrix, b, x0=None, options: SolverOptions = SolverOptions(), driver_rows: int = DRIVER_ROWS) -> tuple[DataFrame, SolverReport]:
    """Solve A x = b from x0; b and x0 are (row, v) tables or, for short ones, arrays. Returns x as (row, v), and a report."""
    return _solve(a, b, x0, None, options, None, driver_rows)


def pcg(a: Matrix, b, x0=None, options: SolverOptions = SolverOptions(), driver_rows: int = DRIVER_ROWS) -> tuple[DataFrame, SolverReport]:
    """The same with a Jacobi preconditioner, unless options turn it off."""
    _check(a)
    return _solve(a, b, x0, inverse_diagonal(a) if options.jacobi else None, options, None, driver_rows, True)


def block_pcg(a: Matrix, b, blocks, x0=None, options: SolverOptions = SolverOptions(), driver_rows: int = DRIVER_ROWS):
    """The same preconditioned by inverse diagonal blocks: see block_diagonal()."""
    _check(a)
    return _solve(a, b, x0, block_diagonal(a.spark, blocks, a.rows), options, None, driver_rows)


def cg_fixed(a: Matrix, b, steps: int, x0=None, options: SolverOptions = SolverOptions(), preconditioned: bool = False, driver_rows: int = DRIVER_ROWS):
    """A fixed number of steps; the report tells at the end whether they were enough."""
    _check(a)
    return _solve(a, b, x0, inverse_diagonal(a) if preconditioned else None, options, steps, driver_rows, True)
