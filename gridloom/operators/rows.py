"""Scans and row indexing: exclusive scan, gather, scatter, compact."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import BROADCAST_ROWS, BY_COLUMNS, BY_ROWS, LANE, Matrix, dealt, whole_lanes

#: Elements of a scan that are ordered in one task.
BUCKET = 100_000
LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)


def _apart(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where df has such a column."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        found.append(name)
    return found


def running_sum(df: DataFrame, at: str, v: str, name: str, bucket: int = BUCKET) -> DataFrame:
    """Add the inclusive running sum of v in the order of `at`, as decimal(38,0), in two levels.

    Buckets of consecutive `at` are summed first; a window runs over the buckets' sums (one row
    for `bucket` elements) and another within each bucket, so no task orders all elements.
    Other columns stay as they are, whatever their names.
    """
    b, x, before = _apart(df, "bucket", "wide", "before")
    wide = df.withColumn(b, F.floor(F.col(at) / bucket)).withColumn(x, F.col(v).cast("decimal(38,0)"))
    sums = wide.groupBy(b).agg(F.sum(x).cast("decimal(38,0)").alias(x))
    behind = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(b, F.coalesce(F.sum(x).over(behind), F.lit(0)).cast("decimal(38,0)").alias(before))
    inside = Window.partitionBy(b).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    total = (F.sum(x).over(inside) + F.col(before)).cast("decimal(38,0)")
    return wide.join(sums, b).withColumn(name, total).drop(b, x, before)


def exclusive_scan(counts: Matrix) -> Matrix:
    """Sums of the elements before each one in column-major order; OverflowError if any prefix leaves 64 bits."""
    # of a sparse matrix only stored elements are summed, as no other changes a sum
    lean = counts.sparse and 0 < counts.rows <= LANE
    lin = (counts if lean else counts.dense()).df.withColumn("lin", F.col("row") + F.col("col") * counts.rows)
    summed = running_sum(lin, "lin", "v", "inc", max(BUCKET, counts.size // BUCKET) if lean else BUCKET)
    out_of_range = summed.where((F.col("inc") > F.lit(LONG_MAX)) | (F.col("inc") < F.lit(LONG_MIN)))
    bad = out_of_range.agg(F.min("lin")).first()[0]
    if bad is not None:
        raise OverflowError(f"the sum of the elements up to {bad} overflows")
    if lean:  # a column begins with the sum of those before it; behind each stored element its own sum holds
        cells = summed.select(F.col("col").alias("lane"), F.col("row").alias("at"), F.col("inc").cast("long").alias("v"))
        sums = counts.df.groupBy("col").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("n"))
        every = counts.spark.range(counts.cols).select(F.col("id").alias("col")).join(sums, "col", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("decimal(38,0)")))
        begun = running_sum(every, "col", "n", "inc").select(F.col("col").alias("lane"), F.lit(-1).cast("long").alias("at"), (F.col("inc") - F.col("n")).cast("long").alias("v"))
        return Matrix(whole_lanes(cells.unionByName(begun), counts.rows, "bigint", True), *counts.shape, layout=BY_COLUMNS)
    return Matrix(summed.select("row", "col", (F.col("inc") - F.col("v")).cast("long").alias("v")), *counts.shape)


def _checked(idx: DataFrame, rows: int) -> None:
    """idx has ord and idx; the first bad index is reported, before anything is computed."""
    bad = idx.where((F.col("idx") < 0) | (F.col("idx") >= rows) | F.col("idx").isNull()).agg(F.min(F.struct("ord", "idx"))).first()[0]
    if bad is not None:
        raise IndexError(f"index {bad['idx']} at {bad['ord']} is not a row of {rows}")


def gather_rows(a: Matrix, idx: DataFrame, count: int) -> Matrix:
    """Row ord of the result is row idx of a; idx has columns (ord, idx), ord from 0 to count - 1."""
    _checked(idx, a.rows)
    if a.layout == BY_ROWS:  # whole rows move
        moved = idx.join(a.source, F.col("idx") == F.col("row")).select(F.col("ord").alias("row"), "values")
        return replace(a, source=moved, rows=count)
    moved = idx.join(a.df, F.col("idx") == F.col("row")).select(F.col("ord").alias("row"), "col", "v")
    return Matrix(moved, count, a.cols, a.sparse)


def scatter_rows(values: Matrix, idx: DataFrame, out: Matrix) -> Matrix:
    """Row ord of values goes to row idx of out; of rows with one target the lowest wins, other rows of out stay."""
    if values.cols != out.cols:
        raise ValueError("values and output differ in columns")
    _checked(idx, out.rows)
    owner = idx.groupBy("idx").agg(F.min("ord").alias("row"))  # one source for each target, before any value moves
    if values.layout == out.layout == BY_ROWS:
        moved = owner.join(values.row_arrays(), "row").select(F.col("idx").alias("row"), F.col("values").alias("new"))
        merged = out.row_arrays().join(moved, "row", "left")
        return Matrix(merged.select("row", F.coalesce("new", "values").alias("values")), *out.shape, layout=BY_ROWS)
    if values.sparse or out.sparse:  # elements that a moved row lacks are zero, also where out had others
        near = out.rows <= BROADCAST_ROWS
        owner = F.broadcast(owner) if near else owner
        deal = lambda m: m.df.select("row", "col", "v") if near else dealt(m.df.select("row", "col", "v"), m.stored, "row")
        moved = deal(values).join(owner, "row").select(F.col("idx").alias("row"), "col", "v")
        stay = deal(out).join(owner.select(F.col("idx").alias("row")), "row", "left_anti")
        merged = Matrix(stay.unionByName(moved), *out.shape, sparse=True, stored=out.stored and out.stored + values.stored)
        return merged if out.sparse else merged.dense()
    moved = owner.join(values.df, "row").select(F.col("idx").alias("row"), "col", F.col("v").alias("w"), F.lit(True).alias("hit"))
    merged = out.df.join(moved, ["row", "col"], "left")
    return Matrix(merged.select("row", "col", F.when(F.col("hit"), F.col("w")).otherwise(F.col("v")).alias("v")), *out.shape)


def compact(df: DataFrame, order: str, keep: Column, name: str = "new_row", bucket: int = BUCKET) -> DataFrame:
    """The rows that keep is true for, numbered from 0 in the order of the unique numbers `order`."""
    (one,) = _apart(df, "one")
    kept = df.where(keep).withColumn(one, F.lit(1))
    return running_sum(kept, order, one, name, bucket).withColumn(name, F.col(name).cast("long") - 1).drop(one)


def compact_rows(a: Matrix, mask: DataFrame) -> tuple[Matrix, DataFrame]:
    """The rows of a with a non-zero mask (row, keep), in order, and (row, source_row) for each."""
    source = compact(mask, "row", F.col("keep") != 0).select(F.col("new_row").alias("row"), F.col("row").alias("source_row"))
    count = source.count()
    if a.layout == BY_ROWS:
        moved = source.join(a.source.withColumnRenamed("row", "source_row"), "source_row").select("row", "values")
        return replace(a, source=moved, rows=count), source
    moved = source.join(a.df.withColumnRenamed("row", "source_row"), "source_row").select("row", "col", "v")
    return Matrix(moved, count, a.cols, a.sparse), source
