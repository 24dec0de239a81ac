"""Document fingerprints: content-defined chunks by a normalised gear hash, compared by weighted containment."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that the gear hash at a position depends on.
WINDOW = 32


@dataclass(frozen=True)
class Chunking:
    """Sizes in bytes. Before `normal` a boundary needs `hard` zero bits of the hash, after it `easy`."""

    least: int = 16
    normal: int = 64
    most: int = 256
    hard: int = 8
    easy: int = 4


def gear_table(seed: int = 7) -> np.ndarray:
    """A random 32-bit value for each byte, and 0 for the padding (256) between documents."""
    return np.append(np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32), np.uint32(0))


GEAR = gear_table()


def gear_hashes(symbols: np.ndarray) -> np.ndarray:
    """hash[i] = sum over k < 32 of GEAR[symbols[i - k]] << k, by doubling the window five times."""
    h = GEAR[symbols]
    width = 1
    while width < WINDOW:
        older = np.zeros_like(h)
        older[width:] = h[:-width] << np.uint32(width)
        h = h + older
        width *= 2
    return h


def chunk_ends(texts: list[bytes], rule: Chunking = Chunking()) -> list[np.ndarray]:
    """For each text the ends of its chunks, in bytes. They depend on nothing but the text.

    All texts are laid out in a row with padding between, hashed at once, and cut side by
    side: each round finds the next boundary of every text that is not at its end.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes + WINDOW)[:-1])) if len(texts) else sizes
    laid = np.full(int((sizes + WINDOW).sum()), 256, np.int16)
    inside = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum())) if len(texts) else sizes
    laid[inside] = np.frombuffer(b"".join(texts), np.uint8)
    h = gear_hashes(laid)
    top = np.uint32(32)
    easy_at = np.flatnonzero((h >> (top - np.uint32(rule.easy)) == 0) & (laid < 256)) + 1  # a chunk ends behind its boundary
    hard_at = easy_at[h[easy_at - 1] >> (top - np.uint32(rule.hard)) == 0]
    beyond = np.iinfo(np.int64).max
    easy_at, hard_at = np.append(easy_at, beyond), np.append(hard_at, beyond)
    doc = np.flatnonzero(sizes)
    at, end = starts[doc], (starts + sizes)[doc]
    cut_doc, cut_at = [], []
    while len(doc):
        hard = hard_at[np.searchsorted(hard_at, at + rule.least)]
        easy = easy_at[np.searchsorted(easy_at, at + rule.normal)]
        cut = np.where(hard <= at + rule.normal, hard, np.minimum(easy, at + rule.most))
        at = np.minimum(cut, end)
        cut_doc.append(doc)
        cut_at.append(at - starts[doc])
        more = at < end
        doc, at, end = doc[more], at[more], end[more]
    if not cut_doc:
        return [np.empty(0, np.int64) for _ in texts]
    docs, ends = np.concatenate(cut_doc), np.concatenate(cut_at)
    order = np.argsort(docs, kind="stable")
    return np.split(ends[order], np.cumsum(np.bincount(docs, minlength=len(texts)))[:-1])


def chunk_sets(texts: list[bytes], rule: Chunking = Chunking()) -> list[dict[int, int]]:
    """For each text its distinct chunks: 64-bit digest -> length in bytes."""
    digest = xxhash.xxh3_64_intdigest
    found = []
    for text, ends in zip(texts, chunk_ends(texts, rule)):
        ends = ends.tolist()
        found.append({digest(text[s:e]): e - s for s, e in zip([0, *ends[:-1]], ends)})
    return found


def encoded(chunks: dict[int, int]) -> str:
    """A chunk set as text: for each digest in order its 8 bytes and the length in 2, in base 64."""
    order = sorted(chunks.items())
    raw = np.zeros(len(order), [("d", "<u8"), ("n", "<u2")])
    raw["d"], raw["n"] = [d for d, _ in order], [n for _, n in order]
    return base64.b64encode(raw.tobytes()).decode()


def decoded(fingerprint: str) -> dict[int, int]:
    raw = np.frombuffer(base64.b64decode(fingerprint), [("d", "<u8"), ("n", "<u2")])
    return dict(zip(raw["d"].tolist(), raw["n"].tolist()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's bytes, counted by distinct chunk, that lie in chunks that b has too.

    Two empty sets contain each other (1); an empty one and another have nothing in common (0).
    """
    if not a or not b:
        return float(not a and not b)
    return sum(a[d] for d in a.keys() & b.keys()) / sum(a.values())


OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("n_chunks", pa.int64()),
    ]
)
OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_chunks long"


def _with_next(batches: Iterator[pa.RecordBatch], rule: Chunking, most_chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows come in ranges, sorted; each own row of a range is paired with the row behind it."""
    held: list[tuple[int, bool, int | None, str]] = []  # range, sent along from the next range, doc_id, text
    size = 0

    def done() -> pa.RecordBatch | None:
        """The rows that have a successor by now; the last one stays."""
        nonlocal held, size
        pairs = [(row, after) for row, after in zip(held, held[1:]) if row[0] == after[0] and not row[1]]
        texts = {id(row): row[3] for pair in pairs for row in pair}
        sets = dict(zip(texts, chunk_sets([t.encode("utf-8", "surrogatepass") for t in texts.values()], rule)))
        edited = []
        for row, after in pairs:
            k = len(row[3]) // 2
            edited.append((row[3][: len(row[3]) - k] + after[3][:k]).encode("utf-8", "surrogatepass"))
        rows = []
        for (row, after), new, new_set in zip(pairs, edited, chunk_sets(edited, rule)):
            own = sets[id(row)]
            near = containment(own, new_set), containment(own, sets[id(after)])
            rows.append((row[2], len(row[3]), hashlib.sha256(new).hexdigest(), encoded(own), encoded(new_set), *near, len(own)))
        held = held[-1:]
        size = len(held[0][3]) if held else 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT) if rows else None

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("span", "sent", "doc_id", "text"))):
            held.append(row)
            size += len(row[3])
            if size > most_chars and (out := done()):
                yield out
    if out := done():
        yield out


def fingerprint_documents(docs: DataFrame, rule: Chunking = Chunking(), ranges: int | None = None) -> DataFrame:
    """(doc_id, text) -> fingerprint of each text, and how near it is to its edited text and to the next document.

    The next document is the one behind in descending doc_id (null last; rows that share a
    doc_id go by XXH64 of their text, then by text), and the first behind the last. Texts are
    shuffled once: quantiles of doc_id cut the table into ranges, and the first row of each
    range is also sent to the range before it; so every row is met by its successor in one
    sorted stream. A doc_id that fills several quantiles is cut further by that hash, as are
    the rows without doc_id, so no task gets a hot doc_id whole. What the driver holds is one
    doc_id and hash for each range. Rows equal in both columns stay in one range and are each
    other's successors.

    Null text counts as empty: no chunks, fingerprint ''. Other columns are not read. A single
    document is its own successor; an empty table gives no row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = ranges or 4 * partitions
    total, known = rows.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    if not total:
        return docs.sparkSession.createDataFrame([], OUT_DDL)
    quantiles = rows.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    largest = (1 << 63) - 1
    filled = Counter(min(int(q), largest) for q in quantiles)
    # a doc_id that fills several quantiles gets a range of its own, of as many parts
    cuts = sorted(set(filled) | {q + 1 for q, times in filled.items() if times > 1 and q < largest})
    widths = [max(1, filled[c]) for c in reversed(cuts)] + [1, -(-n * (total - known) // total) or 1]  # ranges go down, null comes last
    starts = list(accumulate(widths, initial=0))
    # one string for each list, folded to one constant: a plan does not grow with the number of ranges
    longs = lambda values: F.split(F.lit(",".join("-" if v is None else str(v) for v in values)), ",").try_cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)]) if cuts else F.array(F.lit(0))
    # binary search: how many cuts are at doc_id or below
    below = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(longs(cuts or [0]), at + step - 1) <= F.col("doc_id"), at + step).otherwise(at)
    )
    cut = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - (below if cuts else F.lit(0)))
    width = F.get(longs(widths), F.col("cut"))
    part = F.shiftright((F.shiftright("tie", 32) + F.lit(1 << 31)) * width, 32)
    first = [F.max("doc_id").alias("doc_id")]
    if max(widths) > 1:  # the hash, and so the texts, are read here only where a doc_id is hot
        first.append(F.min(F.when(width > 1, F.col("tie"))).alias("tie"))
    else:
        part = F.lit(0)
    rows = rows.withColumn("cut", cut).withColumn("own", (F.get(longs(starts), F.col("cut")) + part).cast("int"))
    heads = {r["own"]: r.asDict() for r in rows.groupBy("own").agg(*first).collect()}
    order = sorted(heads)
    ahead = dict(zip(order, [order[-1], *order[:-1]]))
    every = range(starts[-1])
    of = lambda field: F.get(longs([heads.get(s, {}).get(field) for s in every]), F.col("own"))
    is_head = F.col("doc_id").eqNullSafe(of("doc_id")) & F.coalesce(F.col("tie") == of("tie"), F.lit(True))
    before = F.get(longs([ahead.get(s, 0) for s in every]), F.col("own")).cast("int")
    place = lambda at, sent: F.struct(at.alias("span"), F.lit(sent).alias("sent"))
    own = place(F.col("own"), False)
    places = F.when(is_head, F.array(own, place(before, True))).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", "tie", F.inline(places))
    task = F.floor(F.col("span").cast("long") * partitions / starts[-1]).cast("int")  # neighbouring ranges, as many in each task
    dealt = dealt.repartitionById(partitions, task).sortWithinPartitions("span", "sent", F.desc_nulls_last("doc_id"), "tie", "text")
    return dealt.drop("tie").mapInArrow(partial(_with_next, rule=rule), OUT_DDL)
