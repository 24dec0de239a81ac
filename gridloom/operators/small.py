"""3 x 3 and other small systems, one a row, computed in Arrow batches."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import columns as C
from ..functions import kernels


def _with_arrays(df: DataFrame, names: list[str], compute) -> DataFrame:
    """Add array columns; compute gets a record batch and returns a list of (values as rows, mask of nulls or None)."""
    schema = StructType([*df.schema.fields, *[StructField(n, ArrayType(DoubleType())) for n in names]])

    def run(batches):
        for batch in batches:
            made = []
            for rows, null in compute(batch):
                offsets = np.arange(0, rows.size + 1, rows.shape[1] or 1, dtype=np.int32)
                mask = None if null is None else pa.array(null)
                made.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()), mask=mask))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def _numbers(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """An array column of `width` numbers as rows; nulls and other lengths are errors."""
    values = batch.column(column)
    if values.null_count or (batch.num_rows and (np.diff(values.offsets.to_numpy()) != width).any()):
        raise ValueError(f"{column} must hold {width} numbers in every row")
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def check_finite(df: DataFrame, column: str, order: str) -> None:
    """ValueError that names the first row, and column in it, that is not finite."""
    bad = F.filter(F.transform(column, lambda v, i: F.when(~C.finite(v), i)), lambda i: i.isNotNull())
    found = df.select(order, F.get(bad, F.lit(0)).alias("at")).where("at is not null").agg(F.min(F.struct(order, "at"))).first()[0]
    if found is not None:
        raise ValueError(f"row {found[0]}, column {found[1]} is not finite")


def symmetric_eigh3(df: DataFrame, column: str, order: str | None = None, on_error: str = "raise") -> DataFrame:
    """Add eigenvalues (3, ascending) and eigenvectors (9: x, y, z of the first, then of the next) of compact [xx, xy, xz, yy, yz, zz].

    With `order` the input is checked first and the lowest bad row is named; on_error="zero"
    gives zeros for rows that are not finite instead.
    """
    if order is not None and on_error == "raise":
        check_finite(df, column, order)

    def compute(batch):
        c = _numbers(batch, column, 6)
        bad = ~np.isfinite(c).all(axis=1)
        if bad.any() and on_error == "raise":
            raise ValueError("a matrix is not finite")
        w, v = kernels.eigh3(np.where(bad[:, None], 0.0, c))
        v = v.transpose(0, 2, 1).reshape(-1, 9)
        v[bad] = 0
        return [(w, None), (v, None)]

    return _with_arrays(df, ["eigenvalues", "eigenvectors"], compute)


def svd3(df: DataFrame, column: str) -> DataFrame:
    """Add u (9), s (3) and vt (9), row-major, of a row-major 3 x 3 matrix."""

    def compute(batch):
        u, s, vt = kernels.svd3(_numbers(batch, column, 9))
        return [(u.reshape(-1, 9), None), (s, None), (vt.reshape(-1, 9), None)]

    return _with_arrays(df, ["u", "s", "vt"], compute)


def solve_small(df: DataFrame, a: str, b: str, n: int, tolerance: float | None = None) -> DataFrame:
    """Add x, the solution of the row-major n x n system a x = b; null where it is singular or not finite."""

    def compute(batch):
        x, ok = kernels.solve_small(_numbers(batch, a, n * n), _numbers(batch, b, n), tolerance)
        return [(x, ~ok)]

    return _with_arrays(df, ["x"], compute)


def spd_inverse(df: DataFrame, a: str, n: int) -> DataFrame:
    """Add inverse (row-major) of a symmetric positive definite matrix; null where it is not one."""

    def compute(batch):
        inverse, ok = kernels.spd_inverse(_numbers(batch, a, n * n).reshape(-1, n, n))
        return [(inverse.reshape(-1, n * n), ~ok)]

    return _with_arrays(df, ["inverse"], compute)


