"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD_PATTERN, materialise, narrow, ranked

#: The hash of a document: the first 60 bits of the MD5 of its doc_id in decimal, a colon and the MD5 of its text ("n" for nulls).
HASH_BITS = 60
#: Up to so many sources their thresholds are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def unit_hash(doc_id: Column, text: Column) -> Column:
    own = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("n")), F.coalesce(F.md5(text), F.lit("n")))
    return F.conv(F.substring(F.md5(own), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size) -> also target: the words of all sources shared by weight, `most` times a source's size at most.

    Sources take the weights in turn by code point, null last. A source is capped when its
    cap is not above its share of what the sources with lower cap-to-weight ratios leave;
    the others share the rest. One row for each source meets in one task here.
    """
    total = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    by_ratio = Window.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        sizes.withColumn("rank", rank)
        .withColumn("weight", F.get(turn, (F.col("rank") % len(weights)).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weights_left"))
        .withColumn("open", F.col("ratio") > F.col("level"))
        .withColumn("order", F.row_number().over(by_ratio))
    )
    level = F.min(F.when(F.col("open"), F.struct("order", "level"))).over(total)["level"]
    capped = F.coalesce(F.col("ratio") <= level, F.lit(True))
    return filled.withColumn("shared", level).select(
        "source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("shared") * F.col("weight")).alias("target")
    )


def thresholds(units: DataFrame, budgets: DataFrame, few: bool, bits: int = 12) -> DataFrame:
    """(source, size, h) and (source, budget) -> (source, edge, base): the hash value in which the budget runs out, and the words before it.

    Level by level, words are summed by source and the next `bits` bits of the hash, within
    the bucket in which the budget runs out; all buckets before it are taken, all behind it
    are not. On the last level a bucket is one hash value. No rows are sorted; windows see at
    most 2**bits sums of a source.
    """
    hint = F.broadcast if few else (lambda df: df)
    edge = budgets.select(F.col("source").alias("s"), "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"))
    for used in range(bits, HASH_BITS + 1, bits):
        shift = HASH_BITS - used
        inside = units.join(hint(edge), units["source"].eqNullSafe(edge["s"]) & (F.shiftright("h", shift + bits) == F.col("prefix")))
        sums = inside.groupBy("s", "budget", "base", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("start", F.col("base") + F.coalesce(F.sum("words").over(before), F.lit(0)))
        first = F.min(F.when(F.col("start") + F.col("words") > F.col("budget"), F.struct("bucket", "start")))
        edge = sums.groupBy("s", "budget").agg(first.alias("b")).where("b is not null")
        edge = edge.select("s", "budget", F.col("b.bucket").alias("prefix"), F.col("b.start").alias("base"))
    return edge.select("s", F.col("prefix").alias("edge"), "base")


def _planned(docs: DataFrame, weights: tuple[float, ...], most: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h, cell) of every document, and what each source takes: (g, source_size, target, whole, budget, edge, base)."""
    units = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), unit_hash(F.col("doc_id"), F.col("text")).alias("h"), F.spark_partition_id().alias("cell"))
    units = narrow(units, "mix-units")
    sizes = materialise(units.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    few = sizes.count() <= BROADCAST_SOURCES
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(0)
    goals = targets(sizes, weights, most).withColumn("whole", whole.cast("long"))
    goals = materialise(goals.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-goals")
    cut = thresholds(units, goals.select("source", "budget"), few)
    goals = materialise(goals.join(cut, goals["source"].eqNullSafe(cut["s"]), "left").drop("s").withColumnRenamed("source", "g"), "mix-cuts")
    return units, F.broadcast(goals) if few else goals


def _with_copies(rows: DataFrame, goals: DataFrame, columns: list[str], folder: str | None) -> DataFrame:
    """`columns` and copies of rows with source, size, h and cell.

    Rows with the hash value in which a budget runs out are equal; they are numbered, cell by
    cell, and those are taken once more that bring the sum nearer to the budget. Such rows are
    written first if `folder` is given, as their cells must not change in between.
    """
    keep = [*columns, "whole", "budget", "base", "size"]
    joined = rows.join(goals, rows["source"].eqNullSafe(goals["g"]))
    at_edge = F.col("h").eqNullSafe(F.col("edge"))
    apart = joined.where(~at_edge).select(*columns, (F.col("whole") + F.coalesce(F.col("h") < F.col("edge"), F.lit(False)).cast("long")).alias("copies"))
    edge = joined.where(at_edge).select(*keep, F.struct("g").alias("of"), "cell")
    if folder:
        edge = materialise(edge, folder)
    more = 2 * (F.col("base") + F.col("nth") * F.col("size")) + F.col("size") <= 2 * F.col("budget")
    edge = ranked(edge, ["of"], "cell", [F.lit(0)], "nth").select(*columns, (F.col("whole") + more.cast("long")).alias("copies"))
    return apart.unionByName(edge)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(doc_id, source, text) -> doc_id, size, source_size, target, copies, taken.

    `size` counts words (null text: 0). A source whose target is r times its size takes each
    document floor(r) times, and once more those below its hash threshold; `taken` is size x
    copies. Its sum is within half a document of the target, and the documents of a larger
    target include those of a smaller one. Null and repeated doc_id are told apart by their
    texts, and rows that agree in both by their number, so they are not taken all or none.
    Null source is a source of its own, ordered last. A source without words takes nothing.
    Other columns are not read; an empty table gives no row.
    """
    units, goals = _planned(docs, weights, most)
    found = _with_copies(units, goals, ["doc_id", "size", "source_size", "target"], None)
    return found.withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """The rows of docs, each as often as mix_sources() takes it, whatever their columns are named. Texts are not shuffled, but for rows that agree in doc_id and text where a budget runs out."""
    _, goals = _planned(docs, weights, most)
    text = F.col("text")
    rows = docs.select(F.struct("*").alias("d"), "source", word_count(text).alias("size"), unit_hash(F.col("doc_id"), text).alias("h"), F.spark_partition_id().alias("cell"))
    found = _with_copies(rows, goals, ["d"], "mix-edges").where("copies > 0")
    return found.select("d", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("d.*")


ORACLE = r"""
WITH u AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'n') || ':' || coalesce(md5(text), 'n')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM u GROUP BY source),
w AS (SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
r AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio FROM w),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level,
             row_number() OVER (ORDER BY ratio, rank) AS ord
      FROM r WINDOW b AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, ord) AS shared FROM f WHERE ratio > level),
t AS (SELECT source, source_size, CASE WHEN coalesce(ratio <= shared, true) THEN cap ELSE shared * weight END AS target FROM f, l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u)
SELECT c.doc_id, c.size, g.source_size, g.target,
       c.size * (g.whole + CASE WHEN 2 * start + size <= 2 * (target - whole * source_size) AND target > whole * source_size THEN 1 ELSE 0 END) AS taken
FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source
"""
