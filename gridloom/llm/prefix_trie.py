"""Conversation prefix trie: sorted runs that carry LCPs, merged by a loser tree, closed node by node from an open path."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import drop_scratch, materialise

#: Bytes of a turn in a path: half a SHA-256 of role and text, then the bytes of the text, big-endian.
CELL, DIGEST = 24, 16
#: Bytes of paths that are sorted as one run, and that are merged in one task.
RUN_BYTES, RANGE_BYTES = 1 << 23, 1 << 25
#: Paths that are drawn for each range, and turns of each that may cut ranges.
DRAWN, CUT_TURNS = 8, 64
#: conv_ids of one number when divided by this are listed in one string.
LISTED = 4096
#: Open nodes are broadcast up to so many.
BROADCAST_NODES = 1_000_000


def common(x: bytes, y: bytes, known: int = 0) -> int:
    """How many leading turns two paths share, of which `known` are known."""
    at, end = known * CELL, min(len(x), len(y))
    while at < end and x[at : at + CELL] == y[at : at + CELL]:
        at += CELL
    return at // CELL


def sorted_run(paths: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of distinct paths, and for each in that order the turns it shares with the one before."""
    order = sorted(range(len(paths)), key=paths.__getitem__)
    return order, [0, *(common(paths[a], paths[b]) for a, b in zip(order, order[1:]))][: len(order)]


def merged_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, turns shared with the path before) of all paths of sorted runs, in order.

    A loser tree of which each player knows how many turns it shares with the last winner: of two
    players the one that shares more is the smaller, and only where both share as many are their
    turns compared, from there on. No turn that was found shared is looked at again.
    """
    live = [i for i, (paths, _) in enumerate(runs) if paths]
    if not live:
        return
    width = 1 << (len(live) - 1).bit_length()
    at, shared = [0] * len(runs), [0] * len(runs)
    head: list[bytes | None] = [paths[0] if paths else None for paths, _ in runs]
    none = -1

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows what it shares with the winner."""
        if a == none or b == none:
            return (b, a) if a == none else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = head[a], head[b]
        n = common(x, y, shared[a])
        cut = n * CELL
        win, lose = (a, b) if x[cut : cut + CELL] <= y[cut : cut + CELL] else (b, a)
        shared[lose] = n
        return win, lose

    losers = [none] * width
    level = [live[i] if i < len(live) else none for i in range(width)]
    leaf = {run: width + i for i, run in enumerate(level) if run != none}
    first = width
    while len(level) > 1:
        first //= 2
        played = [play(level[i], level[i + 1]) for i in range(0, len(level), 2)]
        losers[first : first + len(played)] = [lose for _, lose in played]
        level = [win for win, _ in played]
    winner = level[0]
    while winner != none:
        yield winner, at[winner], shared[winner]
        paths, lcps = runs[winner]
        node, at[winner] = leaf[winner] // 2, at[winner] + 1
        if at[winner] < len(paths):
            head[winner], shared[winner], player = paths[at[winner]], lcps[at[winner]], winner
        else:
            player = none
        while node:
            player, losers[node] = play(player, losers[node])
            node //= 2
        winner = player


class _Open:
    """A node on the open path."""

    __slots__ = ("conv", "n", "children", "leaves", "saved", "ends", "size", "cut", "held")

    def __init__(self, size: int, cut: bool):
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, None
        self.size, self.cut, self.held = size, cut, []


NODES = pa.schema(
    [
        ("key", pa.binary()),
        ("parent", pa.binary()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved", pa.decimal128(38, 0)),
        ("ends", pa.string()),
        ("size", pa.int64()),
    ]
)
NODES_DDL = (
    "key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved decimal(38,0), ends string, size long"
)


def finished_nodes(stream: Iterator[tuple[bytes, int, int, int, str]], low: bytes, high: bytes) -> Iterator[tuple]:
    """Rows of NODES from sorted distinct paths (path, turns shared with the one before, least conv_id, conversations, digest of their ids).

    Nodes stay on a stack while paths go through them. One whose prefix also begins paths of
    another range, as it is a part of the path `low` or `high` that cuts this one off, is `cut`:
    its row has a key and counts what this range alone knows. All others are whole, and wait at
    their parent for its conv_id, unless that is cut.
    """
    stack: list[_Open] = []
    path = b""

    def close() -> Iterator[tuple]:
        node, depth = stack.pop(), len(stack)
        above = stack[-1] if stack else None
        parent = path[: (depth - 1) * CELL] if above is not None and above.cut else None
        if above is not None:
            above.n += node.n
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
        if node.cut:
            yield path[: depth * CELL], parent, node.conv, depth, None, node.n, node.children, node.leaves, node.saved, node.ends, node.size
            return
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
        for row in node.held:
            yield (*row[:4], node.conv, *row[5:])
        row = (None, parent, node.conv, depth, None, node.n, node.children, leaves, saved, node.ends, node.size)
        if above is None or above.cut:
            yield row
        else:
            above.held.append(row)
        if above is not None:
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved

    for new, shared, conv, n, ends in stream:
        while len(stack) > shared + 1:
            yield from close()
        path = new
        turns = len(path) // CELL
        # down to which depth a proper part of a cutting path is met
        cut = max((min(common(path, edge), len(edge) // CELL - 1) for edge in (low, high) if edge), default=-1)
        for depth in range(len(stack), turns + 1):
            end = depth * CELL
            stack.append(_Open(int.from_bytes(path[end - CELL + DIGEST : end], "big") if depth else 0, depth <= cut))
        top = stack[-1]
        top.n, top.conv, top.ends = top.n + n, conv if top.conv is None else min(top.conv, conv), ends
    while stack:
        yield from close()


RUNS = pa.schema(
    [
        ("range", pa.int32()),
        ("paths", pa.list_(pa.binary())),
        ("shared", pa.list_(pa.int32())),
        ("conv_ids", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.string())),
    ]
)
RUNS_DDL = "range int, paths array<binary>, shared array<int>, conv_ids array<long>, counts array<long>, ends array<string>"


def _runs(batches: Iterator[pa.RecordBatch], cuts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of what a task holds, dealt out by range; one row for each range that a run touches."""
    held: list[list] = [[], [], [], []]
    size = 0

    def run() -> Iterator[pa.RecordBatch]:
        paths, convs, counts, ends = held
        order, shared = sorted_run(paths)
        line = [paths[i] for i in order]
        borders = [0, *(bisect_left(line, cut) for cut in cuts), len(line)] if len(cuts) < len(line) else None
        if borders is None:  # more ranges than paths
            of = [bisect_right(cuts, path) for path in line]
            borders, ranges = [i for i in range(len(of)) if not i or of[i] != of[i - 1]] + [len(of)], sorted(set(of))
        else:
            ranges = range(len(cuts) + 1)
        for r, a, b in zip(ranges, borders, borders[1:]):
            if a < b:
                take = order[a:b]
                row = [r, line[a:b], [0, *shared[a + 1 : b]], [convs[i] for i in take], [counts[i] for i in take], [ends[i] for i in take]]
                yield pa.RecordBatch.from_arrays([pa.array([value], field.type) for value, field in zip(row, RUNS)], schema=RUNS)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("path", "conv_id", "n", "ends"))):
            for column, value in zip(held, row):
                column.append(value)
            size += len(row[0]) + CELL
            if size > RUN_BYTES:
                yield from run()
                held, size = [[], [], [], []], 0
    if held[0]:
        yield from run()


def _merged(batches: Iterator[pa.RecordBatch], cuts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The finished nodes of the ranges of a task, each merged from its runs."""
    pieces: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(batch.column(f.name).to_pylist() for f in RUNS)):
            pieces.setdefault(row[0], []).append(row[1:])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        rows = [(*row[:8], Decimal(row[8]), *row[9:]) for row in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), NODES)], schema=NODES)

    for r in sorted(pieces):
        runs = pieces.pop(r)
        stream = ((runs[i][0][k], shared, runs[i][2][k], runs[i][3][k], runs[i][4][k]) for i, k, shared in merged_runs([(run[0], run[1]) for run in runs]))
        rows = []
        for row in finished_nodes(stream, cuts[r - 1] if r else b"", cuts[r] if r < len(cuts) else b""):
            rows.append(row)
            if len(rows) == 8192:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, part, ids, first, n), sorted: one row for each path, with the SHA-256 of all its ids, comma-joined."""
    path, digest, first, n = None, None, 0, 0
    names = ["path", "conv_id", "n", "ends"]
    types = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        rows = []
        for p, ids, least, count in zip(*(batch.column(c).to_pylist() for c in ("path", "ids", "first", "n"))):
            if p == path:
                digest.update(b"," + ids.encode())
                n += count
                continue
            if path is not None:
                rows.append((path, first, n, digest.hexdigest()))
            path, digest, first, n = p, hashlib.sha256(ids.encode()), least, count
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    if path is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path, first, n, digest.hexdigest()), types)], names)


def rebuilt_paths(conversations: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, path) of every conversation, rebuilt on the first turns of the head of its family.

    The head of c is c - c % family; c takes the head's first h turns, h = crc32(c) % heads, and
    then its own behind its first h. Turns are ordered by turn, null first, and by digest where
    that ties. One shuffle, by family.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    known = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    cell = F.concat(F.substring(F.sha2(known, 256), 1, 2 * DIGEST), F.lpad(F.hex(F.octet_length(text).cast("long")), 2 * (CELL - DIGEST), "0"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", cell.alias("cell"))
    turns = turns.withColumn("head", F.col("conv_id") - F.col("conv_id") % family).repartition("head")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "cell"))), lambda x: x["cell"]), "")
    own = turns.groupBy("head", "conv_id").agg(line.alias("cells"))
    together = own.groupBy("head").agg(F.collect_list(F.struct("conv_id", "cells")).alias("all"))
    first = F.coalesce(F.get(F.filter("all", lambda x: x["conv_id"] == F.col("head")), F.lit(0))["cells"], F.lit(""))
    each = together.select(first.alias("first"), F.inline("all"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads * (2 * CELL)).cast("int")
    path = F.concat(F.substring(F.col("first"), F.lit(1), h), F.substring(F.col("cells"), h + 1, F.length("cells")))
    return each.select("conv_id", F.unhex(path).alias("path"))


def distinct_paths(paths: DataFrame) -> DataFrame:
    """(conv_id, path) -> (path, conv_id, n, ends): the least conv_id of each path, how many have it, and the SHA-256 of their list.

    The list of a path is written in parts of LISTED numbers, in parallel, and only these parts
    come together: a path that a third of all conversations have is a stream of parts in one task.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    part = F.floor(F.col("conv_id") / LISTED).alias("part")
    parts = paths.groupBy("path", part).agg(ids.alias("ids"), F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return parts.repartition("path").sortWithinPartitions("path", "part").mapInArrow(_ends, "path binary, conv_id long, n long, ends string")


def range_cuts(paths: DataFrame, range_bytes: int) -> list[bytes]:
    """Paths that cut the table into ranges of about range_bytes, from a sample by hash of DRAWN for each range.

    They only balance the work: a cut is the beginning of a path that is there, of CUT_TURNS turns at most.
    """
    rows, size = paths.agg(F.count(F.lit(1)), F.sum(F.length("path") + CELL)).first()
    ranges = -(-(size or 0) // range_bytes)
    if ranges < 2:
        return []
    part = min(1.0, DRAWN * ranges / rows)
    drawn = paths.where(F.pmod(F.xxhash64("path"), F.lit(1 << 40)) < int(part * (1 << 40))).select(F.substring("path", 1, CUT_TURNS * CELL)).collect()
    line = sorted(bytes(row[0]) for row in drawn)
    return sorted({line[len(line) * i // ranges] for i in range(1, ranges)} - {b""}) if line else []


def prefix_trie(conversations: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(conv_id, turn, role, text) -> a row for each distinct sequence of first turns of the rebuilt conversations.

    conv_id is the least member of the node, parent_conv_id that of its parent (null at the
    root), n_convs its members, n_children and n_leaves its children and the childless nodes
    below, saved_tokens the bytes that its subtree stores once instead of per member, ends_sha256
    the digest of the members that end there.

    Rebuilt conversations become paths of 24 bytes a turn (equal turns are those with equal
    halves of SHA-256). Equal paths are counted first, so that none is hot. Tasks sort what they
    hold into runs that carry LCPs, cut by range of path; a task for each range merges its runs
    and closes nodes from its open path. Nodes that several ranges share are parts of the paths
    that cut ranges, at most CUT_TURNS for each; they are added up by prefix.

    Null role or text is empty; rows without conv_id belong to no conversation; repeated rows are
    turns of their own; a table without rows has no node. Other columns are not read. The turns
    of one conversation, 24 bytes each, are held by one task.
    """
    distinct = materialise(distinct_paths(rebuilt_paths(conversations)), "trie-paths")
    cuts = range_cuts(distinct, range_bytes)
    runs = distinct.mapInArrow(partial(_runs, cuts=cuts), RUNS_DDL).repartitionById(len(cuts) + 1, F.col("range"))
    nodes = runs.mapInArrow(partial(_merged, cuts=cuts), NODES_DDL)
    if not cuts:
        return _shown(nodes.withColumn("above", F.lit(None).cast("long")))
    nodes = materialise(nodes, "trie-nodes")
    drop_scratch(distinct)
    local = nodes.where("key is not null").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"), F.first("size").alias("size"),
    )
    local = materialise(local, "trie-cut-nodes")
    prefix = lambda depth: F.substring(F.col("key"), F.lit(1), (depth * CELL).cast("int"))
    own = F.col("saved") + (F.col("n_convs") - 1) * F.col("size")
    above = local.select(F.explode(F.sequence(F.lit(0).cast("long"), "depth")).alias("up"), "key", "n_leaves", own.alias("saved"))
    above = above.groupBy(prefix(F.col("up")).alias("key")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    born = local.where("depth > 0").groupBy(prefix(F.col("depth") - 1).alias("key")).agg(F.count(F.lit(1)).alias("more"))
    named = local.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    named = F.broadcast(named) if len(cuts) * CUT_TURNS <= BROADCAST_NODES else named
    cut = local.drop("n_leaves", "saved").join(above, "key").join(born, "key", "left")
    cut = cut.withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).withColumn("parent", F.when(F.col("depth") > 0, prefix(F.col("depth") - 1)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends", "parent"]
    every = nodes.where("key is null").select(columns).unionByName(cut.withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns))
    return _shown(every.join(named, "parent", "left"))


def _shown(nodes: DataFrame) -> DataFrame:
    nothing: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").cast("long").alias("saved_tokens"), F.coalesce("ends", nothing).alias("ends_sha256"),
    )


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT role, text, row_number() OVER () AS id, strlen(text) AS size FROM (SELECT DISTINCT role, text FROM t)),
own AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST) AS turns FROM t JOIN ids USING (role, text) GROUP BY conv_id),
drawn AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 9 AS h FROM own),
rebuilt AS (SELECT d.conv_id, list_concat(coalesce(b.turns[1:d.h], []), d.turns[d.h + 1:]) AS path FROM drawn d LEFT JOIN own b ON b.conv_id = d.conv_id - d.conv_id % 5),
prefixes AS (SELECT conv_id, d, path[1:d] AS p, len(path) = d AS ends FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefixes GROUP BY p),
born AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
facts AS (SELECT nodes.*, coalesce(born.n, 0) AS n_children, (n_convs - 1) * coalesce(size, 0) AS own FROM nodes LEFT JOIN born USING (p) LEFT JOIN ids ON id = nodes.p[nodes.depth]),
sums AS (SELECT p[1:up] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(depth + 1)) AS up FROM facts) GROUP BY 1)
SELECT f.conv_id, f.depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM facts f JOIN sums s USING (p) LEFT JOIN nodes a ON f.depth > 0 AND a.p = f.p[1:f.depth - 1]
"""
