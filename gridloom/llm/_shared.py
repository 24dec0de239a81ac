"""What several operators share: scratch tables, ranks and small expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import drop_folders, folders_of, materialise, scratch_dir
from ..shipping import send_package

__all__ = ["WORD_PATTERN", "ascii_lower", "drop_scratch", "free_names", "joined_by_share", "materialise", "narrow", "ranked", "read_table", "scratch_dir", "scratch_path"]

#: Words as the operators count them: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind where df has such a column."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def narrow(df: DataFrame, name: str) -> DataFrame:
    """materialise() for few bytes out of many that each task read: rows are dealt out anew, in files of the usual size."""
    return materialise(df.hint("rebalance"), name)


def drop_scratch(df: DataFrame) -> None:
    """Delete the scratch table that df reads, if it reads one; nothing lazy may still need it."""
    drop_folders(df.sparkSession, folders_of(df))


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the corpus; this is also where executors get the package."""
    send_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def joined_by_share(rows: DataFrame, table: DataFrame, key: Column, of: str, weight: str, most: int = 50_000) -> DataFrame:
    """rows, left-joined to a table that has one row for each value of `of` and in `weight` how many rows carry it.

    Values that more than one in `most` of all carriers carry (and a thousand at least) are
    fewer than `most`, whatever the size of the tables: these are broadcast. The others' rows
    are joined by shuffle, and rows whose key is null are not joined at all. So no task gets
    the rows of a hot value. The table is read several times and should be a written one.
    """
    carriers = table.agg(F.sum(weight)).first()[0] or 0
    least = max(1000, carriers // most)
    hot = F.broadcast(table.where(F.col(weight) > least))
    marked = rows.withColumn("__key", key).join(hot, F.col("__key") == F.col(of), "left")
    apart = F.col("__key").isNull() | F.col(of).isNotNull()
    rest = marked.where(~apart).select(*rows.columns, "__key").join(table.where(F.col(weight) <= least), F.col("__key") == F.col(of), "left")
    return marked.where(apart).unionByName(rest).drop("__key")


def ranked(df: DataFrame, part: list[str], cell: str, order: list[Column], name: str) -> DataFrame:
    """Add `name`: the rank from 0 within `part`, ordered by (`cell`, *order), in two levels.

    `cell` is an int of bounded range that comes first in the order. Rows are numbered within
    their cell, and the sizes of the cells before it are added; so no task sorts a whole part.
    The table of cell sizes has at most (parts x cells) rows, which bounds what is broadcast.
    """
    key = [*part, cell]
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*part).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*key, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*key).orderBy(*order)
    return (
        df.join(F.broadcast(sizes), key)
        .withColumn(name, F.row_number().over(within) - 1 + F.col("__before"))
        .drop("__before")
    )
