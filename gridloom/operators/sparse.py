"""Triplets and compressed sparse rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..matrix import Matrix, dealt
from .rows import running_sum


@dataclass(frozen=True)
class Triplets:
    """An append-only list of (ord, row, col, v); equal positions add up in the order of ord."""

    df: DataFrame
    rows: int
    cols: int

    def __post_init__(self):
        if self.rows < 0 or self.cols < 0:
            raise ValueError("dimensions must not be negative")

    @staticmethod
    def of(spark: SparkSession, rows: int, cols: int, entries: list[tuple[int, int, float]]) -> Triplets:
        for r, c, _ in entries:
            if not (0 <= r < rows and 0 <= c < cols):
                raise IndexError(f"({r}, {c}) is outside of {rows} x {cols}")
        table = [(i, r, c, float(v)) for i, (r, c, v) in enumerate(entries)]
        return Triplets(spark.createDataFrame(table, "ord bigint, row bigint, col bigint, v double"), rows, cols)

    def add(self, more: DataFrame) -> Triplets:
        """Append (row, col, v), each behind all that are there, in the order of its `ord`."""
        last = self.df.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
        return Triplets(self.df.unionByName(more.select((F.col("ord") + last).alias("ord"), "row", "col", "v")), self.rows, self.cols)

    def nnz(self) -> int:
        return self.df.count()


@dataclass(frozen=True)
class CompressedRows:
    """Stored elements (pos, row, col, v) in row and column order, and offsets (row, offset) for rows 0 to `rows`."""

    elements: DataFrame
    offsets: DataFrame
    rows: int
    cols: int

    @property
    def matrix(self) -> Matrix:
        """The stored elements in coordinate form, for the products."""
        return Matrix(self.elements.select("row", "col", "v"), self.rows, self.cols, sparse=True)

    def nnz(self) -> int:
        return self.offsets.where(F.col("row") == self.rows).first()["offset"]


def check_triplets(t: Triplets, require_finite: bool = False) -> None:
    """One aggregate over all triplets; the first bad one is named, range before value."""
    outside = (F.col("row") < 0) | (F.col("row") >= t.rows) | (F.col("col") < 0) | (F.col("col") >= t.cols)
    found = t.df.agg(
        F.min(F.when(outside, F.struct("ord", "row", "col"))).alias("range"),
        F.min(F.when(~C.finite(F.col("v")), F.col("ord"))).alias("value"),
    ).first()
    if found["range"] is not None:
        bad = found["range"]
        raise IndexError(f"triplet {bad['ord']} at ({bad['row']}, {bad['col']}) is outside of {t.rows} x {t.cols}")
    if require_finite and found["value"] is not None:
        raise ValueError(f"triplet {found['value']} is not finite")


def _ordered_sums(batches):
    """Sorted rows (row, col, v): the sum of each position in the order in which its rows come; what a batch leaves open goes on in the next."""
    last, total = None, 0.0

    def made(rows, cols, sums):
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cols), pa.array(sums)], ["row", "col", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        row, col, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "col", "v"))
        at = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (col[1:] != col[:-1]))))
        size = np.diff(np.append(at, len(row)))
        sums = v[at].astype(float)
        joined = last == (row[0], col[0])
        if joined:
            sums[0] = total + sums[0]
        for rank in range(1, min(int(size.max()), 32)):  # the next of all positions that have so many
            some = np.flatnonzero(size > rank)
            sums[some] += v[at[some] + rank]
        for i in np.flatnonzero(size > 32):  # positions with many: one after the other, as accumulate() adds
            sums[i] = np.add.accumulate(np.concatenate(([sums[i]], v[at[i] + 32 : at[i] + size[i]])))[-1]
        if last is not None and not joined:
            yield made([last[0]], [last[1]], [total])
        yield made(row[at[:-1]], col[at[:-1]], sums[:-1])
        last, total = (row[at[-1]], col[at[-1]]), float(sums[-1])
    if last is not None:
        yield made([last[0]], [last[1]], [total])


def combine(t: Triplets, ordered: bool = True) -> Matrix:
    """One element for each position: duplicates are summed in insertion order, zeros stay.

    Positions are dealt out by hash and added up as their sorted rows stream by, so a position may
    have any number of duplicates. With ordered=False the sum may take any order, which allows
    partial sums before the shuffle, as long as triplets are few enough for the session's tasks.
    """
    n = t.nnz()
    if not ordered:
        return Matrix(dealt(t.df.select("row", "col", "v"), n, "row", "col").groupBy("row", "col").agg(F.sum("v").alias("v")), t.rows, t.cols, sparse=True, stored=n)
    rows = dealt(t.df.select("row", "col", "ord", F.col("v").cast("double").alias("v")).repartition("row", "col"), n, "row", "col").sortWithinPartitions("row", "col", "ord")
    return Matrix(rows.select("row", "col", "v").mapInArrow(_ordered_sums, "row long, col long, v double"), t.rows, t.cols, sparse=True, stored=n)


def row_offsets(m: Matrix) -> DataFrame:
    """(row, offset) for rows 0 to m.rows: how many stored elements the rows before hold."""
    counts = m.df.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    every = m.spark.range(m.rows).select(F.col("id").alias("row")).join(counts, "row", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    behind = running_sum(every, "row", "n", "offset").select((F.col("row") + 1).alias("row"), F.col("offset").cast("long").alias("offset"))
    first = m.spark.range(1).select(F.col("id").alias("row"), F.lit(0).cast("long").alias("offset"))
    return first.unionByName(behind)


def compress(t: Triplets, require_finite: bool = False, ordered: bool = True) -> CompressedRows:
    """Triplets to compressed rows: check, combine, number.

    The position of an element is its row's offset plus its rank in the row.
    """
    check_triplets(t, require_finite)
    m = combine(t, ordered)
    offsets = row_offsets(m)
    rank = F.row_number().over(Window.partitionBy("row").orderBy("col")) - 1
    elements = m.df.withColumn("rank", rank).join(offsets, "row").select((F.col("offset") + F.col("rank")).alias("pos"), "row", "col", "v")
    return CompressedRows(elements, offsets, t.rows, t.cols)


def validate(csr: CompressedRows) -> dict[str, bool]:
    """Whether offsets start at 0, end at the number of elements and never fall, columns are in range and values finite."""
    # neighbours by join, as a window would order all rows in one task
    ahead = csr.offsets.select((F.col("row") + 1).alias("row"), F.col("offset").alias("last"))
    offsets = csr.offsets.join(ahead, "row", "left").withColumn("step", F.col("offset") - F.coalesce("last", F.lit(0)))
    o = offsets.agg(
        F.min(F.when(F.col("row") == 0, F.col("offset"))).alias("first"),
        F.max(F.when(F.col("row") == csr.rows, F.col("offset"))).alias("last"),
        F.min("step").alias("least"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    e = csr.elements.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("col") < 0) | (F.col("col") >= csr.cols)).alias("outside"),
        F.count_if(~C.finite(F.col("v"))).alias("odd"),
    ).first()
    return {
        "starts_at_zero": o["first"] == 0,
        "ends_at_nnz": o["last"] == e["n"],
        "never_falls": o["least"] >= 0 and o["n"] == csr.rows + 1,
        "columns_in_range": e["outside"] == 0,
        "values_finite": e["odd"] == 0,
    }
