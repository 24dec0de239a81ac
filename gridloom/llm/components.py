"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_scratch, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """Undirected links (a long, b long) -> (node, root): root is the smallest node reached.

    Only linked nodes are returned. Each round hangs the larger neighbours of a node on its
    smallest neighbour (large star), then the smaller ones (small star), until nothing
    changes; the rounds grow with the logarithm of the longest path. Each round's table is
    written to the shared folder. Minima are aggregated before they are shuffled, and joins
    on a node with many neighbours are left to adaptive execution to split.
    """
    edges = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large-star")
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lows.select("u", F.col("m").alias("v"))).distinct()
        stars = materialise(small, "small-star")
        drop_scratch(large)
        drop_scratch(edges)
        edges = stars
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
