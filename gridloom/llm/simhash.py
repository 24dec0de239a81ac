"""SimHash near-duplicates: an inverted index over byte positions with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._shared import free_names, materialise, narrow
from .components import connected_components

#: XXH64 seed of the shingle hashes.
SEED = 42
#: Texts of more bytes are split into words by arrays.
LONG = 1 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the `width`-word shingles of a text; 0 for a text without words.

    bytes.split() splits at the ASCII white space x20 and x09-x0D, and at nothing else.
    """
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    joined, ends = _joined(data) if len(data) <= LONG else _joined_apart(data)
    if not len(joined):
        return 0
    if len(ends) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(ends) - width + 1]
    ends = ends[width - 1 :]
    digest, votes = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 15):
        block = zip(starts[at : at + (1 << 15)].tolist(), ends[at : at + (1 << 15)].tolist())
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in block])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(starts)).tobytes(), "big")


def _joined(data: bytes) -> tuple[bytes, np.ndarray]:
    """The words with one space between, and where each ends."""
    words = data.split()
    return b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1


def _joined_apart(data: bytes) -> tuple[memoryview, np.ndarray]:
    """The same in arrays, for long texts: a list of words would take many times their bytes."""
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    keep = ~space
    keep[1:] |= ~space[:-1]  # words, and the first space behind each
    line, gap = raw[keep], space[keep]
    if len(gap) and gap[-1]:
        line, gap = line[:-1], gap[:-1]
    line[gap] = 32
    return memoryview(line), np.append(np.flatnonzero(gap), len(line)) if len(line) else np.empty(0, np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])


def position_sets(matches: int, taken: int, positions: int = 8) -> list[tuple[int, ...]]:
    """Sets of `taken` byte positions such that any `matches` positions include one of the sets.

    Chosen greedily among all sets, so small; for 5 matches and 3 taken positions there are 8.
    """
    halves = [set(range(positions // 2)), set(range(positions // 2, positions))]
    if 2 * taken <= matches + 1:  # some half of the positions holds `taken` of the matches
        return [s for half in halves for s in combinations(sorted(half), taken)]
    open_to = set(combinations(range(positions), matches))
    sets = list(combinations(range(positions), taken))
    chosen = []
    while open_to:
        best = max(sets, key=lambda s: sum(set(s) <= set(o) for o in open_to))
        chosen.append(best)
        open_to = {o for o in open_to if not set(best) <= set(o)}
    return chosen


class Forest:
    """Union-find over positions 0..n-1 that takes arrays of edges."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.parent[at]
        while True:
            above = self.parent[found]
            if np.array_equal(above, found):
                return found
            found = above

    def link(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join a[i] and b[i] for every i; returns the edges that joined two trees."""
        kept_a, kept_b = [], []
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            open_to = ra != rb
            if not open_to.any():
                break
            a, b, ra, rb = a[open_to], b[open_to], ra[open_to], rb[open_to]
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            _, first = np.unique(high, return_index=True)  # each tree is hung up once a round
            self.parent[high[first]] = low[first]
            kept_a.append(a[first])
            kept_b.append(b[first])
        if not kept_a:
            return a[:0], b[:0]
        return np.concatenate(kept_a), np.concatenate(kept_b)


def linked(fps: np.ndarray, bounds: np.ndarray, matches: int, distance: int, block: int = 2048):
    """Links between fingerprints of the same run that suffice to connect all that are linked.

    fps are grouped in runs that start at bounds. For each pair in a run the shared positional
    bytes are tallied; pairs with `matches` at least are verified bit by bit. Pairs whose ends
    are connected already give no row, so a run of n fingerprints gives n - 1 links at most.
    """
    n, forest, out = len(fps), Forest(len(fps)), []
    run = np.repeat(np.arange(len(bounds)), np.diff(np.append(bounds, n)))
    ends = np.append(bounds[1:], n)
    last = ends[run]  # where the run of each position ends
    as_bytes = fps.view(np.uint8).reshape(-1, 8)
    longest = int((ends - bounds).max(initial=0))
    alive = np.arange(n)
    for step in range(1, longest):
        alive = alive[alive + step < last[alive]]
        for at in range(0, len(alive), block * 64):
            a = alive[at : at + block * 64]
            b = a + step
            a, b = (lambda keep: (a[keep], b[keep]))(forest.roots(a) != forest.roots(b))
            tally = (as_bytes[a] == as_bytes[b]).sum(axis=1)
            a, b = a[tally >= matches], b[tally >= matches]
            near = np.bitwise_count(fps[a] ^ fps[b]) <= distance
            out.append(forest.link(a[near], b[near]))
    if not out:
        return fps[:0], fps[:0]
    return fps[np.concatenate([x for x, _ in out])], fps[np.concatenate([y for _, y in out])]


def _links(batches: Iterator[pa.RecordBatch], matches: int, distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, fp); a posting list may go on in the next batch."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def done(keys: np.ndarray, fps: np.ndarray):
        bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        a, b = linked(fps, bounds, matches, distance)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        other = np.flatnonzero(keys != keys[-1]) if len(keys) else keys
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield done(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield done(keys, fps)


def _byte_at(position: Column) -> Column:
    """The byte of fp at a position."""
    return F.call_function("shiftrightunsigned", F.col("fp"), (position * 8).cast("int")).bitwiseAND(F.lit(255).cast("long"))


def _postings(fps: DataFrame, matches: int, taken: int) -> DataFrame:
    """(fp, at, key): fp is posted under sets of byte positions, the bits of `at`, and their values."""
    posts = []
    for s in position_sets(matches, taken):
        values = [_byte_at(F.lit(p)) for p in s]
        posts.append(F.struct(F.lit(sum(1 << p for p in s)).alias("at"), F.xxhash64(F.lit(sum(1 << p for p in s)), *values).alias("key")))
    return fps.select("fp", F.inline(F.array(*posts)))


def _longer(postings: DataFrame, matches: int) -> DataFrame:
    """(fp, list, n, at, key): postings of lists of n, under one more position each.

    A pair that shares `matches` positions, and those of `at` among them, misses 8 - matches at
    most of the others: so among any 9 - matches of the others there is one that it shares.
    """
    others = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda p: F.call_function("getbit", F.col("at"), p) == 0)
    more = F.transform(
        F.slice(others, 1, 9 - matches),
        lambda p: F.struct(
            F.col("at").bitwiseOR(F.call_function("shiftleft", F.lit(1), p)).alias("at"), F.xxhash64("key", p, _byte_at(p)).alias("key")
        ),
    )
    return postings.select("fp", F.col("key").alias("list"), "n", F.inline(more))


def fingerprint_links(fps: DataFrame, distance: int = 3, taken: int = 3, list_size: int = 4096) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect all within `distance` bits.

    Two fingerprints that differ in d bits share 8 - d bytes in place at least. The inverted
    index posts a fingerprint under sets of `taken` byte positions and their values, chosen so
    that every pair with enough shared positional bytes meets in a list. Fingerprints of a list
    longer than `list_size` are posted under one more position instead, where that at least
    halves the list and the key has fewer than the guaranteed matches. Other long lists (near
    copies share most bytes) are dealt out: a list is cut into cells by hash, and every pair of
    cells meets in a task of its own. So no task holds a long list and no pair is lost.
    """
    matches = 8 - distance
    postings = _postings(fps, matches, taken)
    lists = []
    for depth in range(taken, matches + 1):
        sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = postings.join(sizes, "key")
        if depth == matches:
            lists.append(sized.select("fp", "key", "n"))
            break
        lists.append(sized.where(F.col("n") <= list_size).select("fp", "key", "n"))
        long = narrow(sized.where(F.col("n") > list_size).select("fp", "at", "key", "n"), "simhash-long")
        if long.isEmpty():
            break
        longer = materialise(_longer(long, matches), "simhash-longer")
        largest = longer.groupBy("list", "n", "key").agg(F.count(F.lit(1)).alias("m")).groupBy("list", "n").agg(F.max("m").alias("m"))
        whole = materialise(largest.where("2 * m > n").select("list"), "simhash-whole")
        lists.append(long.join(whole, long["key"] == whole["list"], "left_semi").select("fp", "key", "n"))
        postings = materialise(longer.join(whole, "list", "left_anti").select("fp", "at", "key"), "simhash-postings")
    postings = reduce(DataFrame.unionByName, lists).withColumn("cells", F.ceil(F.col("n") / list_size).cast("long"))
    own = F.pmod(F.xxhash64("fp", F.lit("cell")), F.col("cells"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    dealt = postings.select("fp", F.explode(F.when(F.col("cells") == 1, F.array("key")).otherwise(others)).alias("key"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = lambda batches: _links(batches, matches, distance)
    return dealt.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fingerprint) of each row, and fp, root, component_id of each fingerprint; root tells the groups apart."""
    prints = narrow(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fingerprint long"), "simhash")
    nodes = materialise(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "simhash-nodes")
    links = narrow(fingerprint_links(nodes.select("fp"), distance), "simhash-links")
    # (fp, root) of the linked fingerprints only; root is the smallest fingerprint reached
    members = connected_components(links)
    linked_nodes = members.join(nodes, members["node"] == nodes["fp"]).select("fp", "root", "least")
    least = linked_nodes.groupBy("root").agg(F.min("least").alias("component"))
    renamed = linked_nodes.select("fp", "root").join(least, "root").select(F.col("fp").alias("f"), "root", "component")
    nodes = materialise(
        nodes.join(renamed, nodes["fp"] == renamed["f"], "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component_id")
        ),
        "simhash-components",
    )
    return prints, nodes


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """(doc_id, text) -> doc_id, fingerprint (long), component_id.

    Documents whose fingerprints differ in `distance` bits or fewer are linked; component_id
    is the smallest doc_id reachable over links. Equal fingerprints are one node of the graph,
    so copies never meet as pairs. Null and empty texts have fingerprint 0, which links like
    any other. Null doc_ids are not candidates for component_id (a component of nulls alone has
    null); repeated rows stay repeated. Other columns are not read; no row, no result.
    """
    prints, nodes = _grouped(docs, distance)
    return prints.join(nodes, prints["fingerprint"] == nodes["fp"]).select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, distance: int = 3) -> DataFrame:
    """One row of docs for each group of near-duplicates: that with the smallest doc_id.

    Of rows of a group that share this doc_id the one with the smallest text stays. Groups are
    told apart by their fingerprints, so a doc_id that is in several groups may stay in each,
    and of a group without any doc_id one row stays. Columns of docs may have any names.
    """
    prints, nodes = _grouped(docs, distance)
    own = prints.join(nodes, prints["fingerprint"] == nodes["fp"])
    id_, count, first, fp, node, root, component, row = free_names(docs, "id", "rows", "first", "fp", "node", "root", "component", "row")
    own = own.groupBy(F.col("doc_id").alias(id_)).agg(
        F.count(F.lit(1)).alias(count), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias(first)
    )
    own = narrow(own.where(F.col(first)), "simhash-kept")
    # shuffled at every size, so that disk grows in proportion; only the ids are hashed, texts are not sorted
    clear = own.where((F.col(count) == 1) & F.col(id_).isNotNull()).hint("shuffle_hash")
    kept = docs.join(clear, docs["doc_id"] == F.col(id_), "left_semi")
    unclear = own.where((F.col(count) > 1) | F.col(id_).isNull())
    if unclear.isEmpty():
        return kept

    def with_fingerprints(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*batch.schema.names, fp])

    # doc_id does not tell these rows apart: their fingerprints do
    rows = docs.join(unclear, docs["doc_id"] == F.col(id_), "left_semi").unionByName(docs.where("doc_id is null"))
    rows = rows.mapInArrow(with_fingerprints, StructType([*docs.schema.fields, StructField(fp, LongType())]))
    groups = nodes.select(F.col("fp").alias(node), F.col("root").alias(root), F.col("component_id").alias(component))
    rows = rows.join(groups, F.col(fp) == F.col(node)).where(F.col("doc_id").eqNullSafe(F.col(component)))
    # an aggregate, so that a large group is reduced where its rows are
    rows = rows.groupBy(root).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.coalesce("text", F.lit("")))).alias(row))
    return kept.unionByName(rows.select(f"{row}.*"))
