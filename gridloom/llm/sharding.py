"""Balanced shards by label propagation: links pull documents together, quotas keep the shards even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import drop_scratch, joined_by_share, materialise, narrow, ranked

#: Cells in which ranks are counted; the tables of cell sizes have a few times as many rows at most.
CELLS = 4096
#: Large groups are told apart by their cells, up to so many at one place.
PLACES = 64
#: A group of at most so many rows is not large in any table.
LEAST_SHARE = 100


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _cell() -> Column:
    """Cells follow the hash of the group; a group with more rows than one in CELLS of all (`share`) has cells of its own, in proportion."""
    own = F.ceil(F.col("n") / F.col("share"))
    by_row = CELLS + F.pmod(F.col("group"), F.lit(PLACES)) * (CELLS + 1) + F.pmod(F.col("h"), own)
    return F.when(F.col("n") > F.col("share"), by_row).otherwise(F.pmod(F.col("group"), F.lit(CELLS))).cast("int")


ORDER = ["group", "h", "doc_id", "text_crc32", "row"]


def _ranked(df: DataFrame, part: list[str], name: str) -> DataFrame:
    """Ranks within `part` that keep the rows of a group together."""
    return ranked(df.withColumn("cell", _cell()), part, "cell", [F.col(c) for c in ORDER], name).drop("cell")


def accepted_moves(demand: dict[tuple[int, int], int], loads: dict[int, int], quotas: list[int]) -> dict[tuple[int, int], int]:
    """How many of the rows that wish to move from a to b may: as many as wish to move back, and what b has room for.

    Exchanges keep every load as it is, so shards that are full still sort themselves out.
    """
    allowed = {(a, b): min(n, demand.get((b, a), 0)) for (a, b), n in demand.items()}
    for b, quota in enumerate(quotas):
        room = max(quota - loads.get(b, 0), 0)
        for a in range(len(quotas)):
            more = min(demand.get((a, b), 0) - allowed.get((a, b), 0), room)
            if more > 0:
                allowed[a, b] += more
                room -= more
    return {pair: n for pair, n in allowed.items() if n}


def propagate(linked: DataFrame, quotas: list[int], rounds: int) -> DataFrame:
    """Label propagation over linked rows (group, label, ...): returns them with new labels.

    In each round every group counts its rows by label (summed before the shuffle) and its
    rows wish for the label that most of them have; a hash of the group decides between equals,
    so that wishes spread over the shards. What reaches the driver is how many rows wish to move from each shard to each other. Moves are accepted by
    the hash of the group, the same order for all pairs of shards, so few groups move in part.
    Nothing depends on the order of rows or tasks. Ends early when no move is left.
    """
    shards = len(quotas)
    for _ in range(rounds):
        counts = linked.groupBy("group", "label").agg(F.count(F.lit(1)).alias("c"))
        best = F.max(F.struct("c", F.xxhash64("group", "label").alias("tie"), "label"))["label"]
        wish = materialise(counts.groupBy(F.col("group").alias("g")).agg(best.alias("wish"), F.sum("c").alias("carriers")), "wish")
        wishes = materialise(joined_by_share(linked, wish, F.col("group"), "g", "carriers").drop("g", "carriers"), "wishes")
        drop_scratch(wish)
        pairs = {(r["label"], r["wish"]): r["count"] for r in wishes.groupBy("label", "wish").count().collect()}
        loads: dict[int, int] = {}
        for (a, _), n in pairs.items():
            loads[a] = loads.get(a, 0) + n
        moves = accepted_moves({pair: n for pair, n in pairs.items() if pair[0] != pair[1]}, loads, quotas)
        if not moves:
            drop_scratch(wishes)
            return linked
        most = F.coalesce(*[F.when(F.col("pair") == a * shards + b, F.lit(n)) for (a, b), n in moves.items()], F.lit(0))
        movers = _ranked(wishes.where("wish <> label").withColumn("pair", F.col("label") * shards + F.col("wish")), ["pair"], "rank")
        movers = movers.withColumn("label", F.when(F.col("rank") < most, F.col("wish")).otherwise(F.col("label")))
        moved = materialise(wishes.where("wish = label").select(*linked.columns).unionByName(movers.select(*linked.columns)), "labels")
        drop_scratch(linked)
        drop_scratch(wishes)
        linked = moved
    return linked


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 6) -> DataFrame:
    """(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard; the law is `rows`.

    Rows with equal texts are linked (null counts as the empty text). Linked rows start with a
    label by hash and propagate labels under the quota of rows that each shard may have, for
    `rounds` rounds at most. Then every shard keeps its linked rows up to its quota, and what
    it can't keep and the rows without links fill the shards that have room. So the counts of
    any two shards differ by one at most, and few equal texts are cut apart. slot numbers the
    rows of a shard from 0 without gaps; grown_shard is null under this law.

    Null and repeated doc_ids are rows like any other; rows equal in both columns are dealt
    out in a fixed but arbitrary way. Other columns are not read; an empty table gives no row.
    All joins are on hashes of texts or on shard numbers; a text that a third of the rows
    share is summed before the shuffle, ranked in cells of its own, and joined by broadcast.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        text_bytes(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = narrow(rows, "shard-rows")
    total = rows.count()
    rows = rows.withColumns({"h": F.xxhash64("doc_id", "row", F.lit("h")), "share": F.lit(max(total // CELLS, LEAST_SHARE))})
    quotas = [total // shards + (at < total % shards) for at in range(shards)]
    copies = materialise(rows.groupBy(F.col("group").alias("g")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shard-copies")
    counted = joined_by_share(rows, copies, F.col("group"), "g", "n").drop("g").withColumn("n", F.coalesce("n", F.lit(1)).cast("long"))
    before, rows = rows, materialise(counted, "shard-groups")
    drop_scratch(copies)
    drop_scratch(before)
    start = F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int")
    linked = materialise(rows.where("n > 1").withColumn("label", start), "labels")
    linked = propagate(linked, quotas, rounds)
    quota = F.get(F.array(*[F.lit(n) for n in quotas]), F.col("label"))
    placed = materialise(_ranked(linked, ["label"], "rank").withColumn("kept", F.col("rank") < quota).drop("rank"), "shard-linked")
    # room that is left in each shard: one number for each reaches the driver
    load = dict(placed.where("kept").groupBy("label").count().collect())
    shard, first = F.lit(None).cast("int"), 0
    for at in range(shards):
        first += quotas[at] - load.get(at, 0)
        shard = F.coalesce(shard, F.when(F.col("rank") < first, F.lit(at)))
    pool = placed.where("not kept").drop("label", "kept").unionByName(rows.where("n = 1"))
    pool = _ranked(pool.withColumn("all", F.lit(0)), ["all"], "rank").drop("all")
    pool = pool.withColumn("shard", shard).drop("rank")
    done = placed.where("kept").drop("kept").withColumnRenamed("label", "shard").unionByName(pool)
    done = materialise(done, "shards")
    return _ranked(done, ["shard"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
