"""Exact repeats of substrings: enhanced suffix arrays over minimizer buckets, maximal repeat groups, removal of later occurrences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Window starts that are hashed at once, and bytes of text in a group and behind a bucket, about.
CHUNK, GROUP_BYTES, BUCKET_BYTES = 1 << 17, 1 << 21, 1 << 22
#: Rows without doc_id stand behind all others.
LAST = np.iinfo(np.int64).max
U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_UP = np.concatenate(([U(1)], np.cumprod(np.full(CHUNK + 4096, U(_BASE)))))
_DOWN = np.concatenate(([U(1)], np.cumprod(np.full(CHUNK + 4096, U(pow(_BASE, -1, 1 << 64))))))


@dataclass(frozen=True)
class Rule:
    """Repeats of `least` bytes count; `gram` bytes make an anchor."""

    least: int = 50
    gram: int = 16

    def __post_init__(self):
        if not 0 < self.gram < self.least <= 2048:
            raise ValueError("an anchor must be shorter than the repeat, and a repeat have 2048 bytes at most")

    @property
    def longest(self) -> int:
        """Bytes of the longest segment."""
        return 2 * self.least - self.gram


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


def _substrings(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each substring of `size` bytes."""
    width = 1
    h = _TABLE[data]
    whole, done = None, 0
    while True:  # binary expansion of size: h covers `width` bytes, `whole` the last `done` bytes before them
        if size & width:
            if whole is None:
                whole, done = h, width
            else:
                n = len(data) - done - width + 1
                whole, done = h[: max(n, 0)] * _UP[done] + whole[width : width + max(n, 0)], done + width
        if done == size:
            return whole
        n = len(data) - 2 * width + 1
        h = h[: max(n, 0)] * _UP[width] + h[width : width + max(n, 0)]
        width *= 2


@dataclass(frozen=True)
class Segments:
    """Stretches of windows with one anchor: each window of `least` bytes lies in exactly one.

    The bytes are data[start:end]; `anchor` hashes the smallest gram of the windows, the first of
    equals, so that equal windows have equal anchors wherever they stand; `digest` hashes the bytes.
    """

    start: np.ndarray
    end: np.ndarray
    anchor: np.ndarray
    digest: np.ndarray | None


def segments(data: np.ndarray, ends: np.ndarray, rule: Rule, with_digest: bool = False) -> Segments:
    """The segments of texts laid end to end in data, text i ending at ends[i]; no window crosses an end.

    A chunk ends where a segment does, so the segments of a text do not depend on where in data it lies.
    """
    k, w, low = rule.least, rule.least - rule.gram + 1, U((1 << 20) - 1)
    found = []
    closing = np.zeros(len(data) + 1, bool)  # windows that cross the end of their text
    for back in range(1, k):
        closing[ends[ends >= back] - back] = True
    at = 0
    while at <= len(data) - k:
        part = data[at : at + max(CHUNK, 2 * w) + k - 1]
        n = len(part) - k + 1
        value = _mixed(_substrings(part, rule.gram))
        packed = (value & ~low) | np.arange(len(value), dtype=np.uint64)
        width = 1
        while 2 * width <= w:
            packed = np.minimum(packed[: len(packed) - width], packed[width:])
            width *= 2
        if width < w:
            packed = np.minimum(packed[:n], packed[w - width : w - width + n])
        best = (packed & low).astype(np.int64)
        open_ = ~closing[at : at + n]
        change = np.ones(n, bool)
        change[1:] = (best[1:] != best[:-1]) | ~open_[:-1]
        first = np.flatnonzero(change & open_)
        stop = np.ones(n, bool)
        stop[:-1] = (best[1:] != best[:-1]) | ~open_[1:]
        last = np.flatnonzero(stop & open_)
        if at + n <= len(data) - k and len(last) and last[-1] == n - 1:  # goes on in the next chunk: begins it
            n, first, last = int(first[-1]), first[:-1], last[:-1]
        digest = None
        if with_digest:
            sums = np.concatenate(([U(0)], np.cumsum(_TABLE[part] * _UP[: len(part)])))
            digest = _mixed((sums[last + k] - sums[first]) * _DOWN[first] + (last + k - first).astype(np.uint64))
        found.append((first + at, last + k + at, value[best[first]], digest))
        at += n
    if not found:
        none = np.empty(0, np.int64)
        return Segments(none, none, none.astype(np.uint64), none.astype(np.uint64))
    start, end, anchor, digest = zip(*found)
    return Segments(np.concatenate(start), np.concatenate(end), np.concatenate(anchor), np.concatenate(digest) if with_digest else None)


def _laid_out(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, ends, doc_id) of the texts of a group, as they come."""
    column = table.column("text").cast(pa.large_binary()).combine_chunks()
    column = column if isinstance(column, pa.LargeBinaryArray) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    _, offsets, raw = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offsets[1:] - offsets[0], table.column("doc_id").fill_null(int(LAST)).combine_chunks().to_numpy(zero_copy_only=False)


def _keys(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper 32 bits, 32 other bits of the anchor in the lower."""
    return (anchor % U(buckets) << U(32)) | (anchor >> U(32))


def _bounds(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.concatenate((np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))), [len(values)])) if len(values) else np.zeros(1, np.int64)


OFFERS = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("keys", pa.binary()), ("twice", pa.binary())])
OFFERS_DDL = "bucket int, g int, keys binary, twice binary"


def _offered(table: pa.Table, rule: Rule, buckets: int) -> pa.Table:
    """The anchors of a group by bucket: 32 bits of each, in order, and whether two of its texts have it."""
    data, ends, _ = _laid_out(table)
    found = segments(data, ends, rule)
    keys, text = _keys(found.anchor, buckets), np.searchsorted(ends, found.start, "right")
    order = np.argsort(keys, kind="stable")
    keys, text = keys[order], text[order]
    at = _bounds(keys)
    twice, keys = text[at[:-1]] != text[at[1:] - 1], keys[at[:-1]]
    bucket = (keys >> U(32)).astype(np.int32)
    at = _bounds(bucket)
    short = keys.astype(np.uint32)
    g = table.column("g")[0].as_py()
    rows = [(bucket[a], g, short[a:b].tobytes(), np.packbits(twice[a:b]).tobytes()) for a, b in zip(at, at[1:])]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OFFERS)], schema=OFFERS) if rows else OFFERS.empty_table()


ANSWERS = pa.schema([("g", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])
ANSWERS_DDL = "g int, bucket int, bits binary"


def _answered(table: pa.Table) -> pa.Table:
    """For each group's anchors of one bucket, which of them more than one text has."""
    groups, buckets = table.column("g").to_pylist(), table.column("bucket").to_pylist()
    lists = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(table.column("twice").to_pylist(), lists)]
    every, flags = np.concatenate(lists), np.concatenate(twice)
    line = np.sort(every)
    many = np.unique(np.concatenate((line[1:][line[1:] == line[:-1]], every[flags])))
    rows = [(g, b, np.packbits(np.isin(k, many, assume_unique=True)).tobytes()) for g, b, k in zip(groups, buckets, lists)]
    rows = [row for row in rows if any(row[2])]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ANSWERS)], schema=ANSWERS) if rows else ANSWERS.empty_table()


def _narrow(values: np.ndarray) -> bytes:
    """Numbers in 4 bytes each if all fit, else in 8."""
    fits = not len(values) or (values.min() >= 0 and values.max() < 1 << 32)
    return values.astype(np.uint32 if fits else np.int64).tobytes()


def _widened(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, np.uint32 if len(data) == 4 * count else np.int64).astype(np.int64)


SENT = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("data", pa.binary()), ("sizes", pa.binary()), ("digests", pa.binary()), ("shorts", pa.binary()), ("low", pa.binary()), ("several", pa.binary()), ("high", pa.binary())])
SENT_DDL = "bucket int, g int, data binary, sizes binary, digests binary, shorts binary, low binary, several binary, high binary"


def _sent(table: pa.Table, answers: pa.Table, rule: Rule, buckets: int) -> pa.Table:
    """The distinct segments of a group whose anchor other texts have too, by bucket, with the least and largest doc_id that has each."""
    if not table.num_rows or not answers.num_rows:
        return SENT.empty_table()
    data, ends, doc = _laid_out(table)
    found = segments(data, ends, rule, with_digest=True)
    keys = _keys(found.anchor, buckets)
    line, back = np.unique(keys, return_inverse=True)
    shared = np.zeros(len(line), bool)
    of = (line >> U(32)).astype(np.int64)
    for bucket, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()):
        a, b = np.searchsorted(of, [bucket, bucket + 1])
        shared[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    pick = np.flatnonzero(shared[back])
    pick = pick[np.lexsort((found.digest[pick], found.anchor[pick], keys[pick] >> U(32)))]
    if not len(pick):
        return SENT.empty_table()
    digest, anchor, key = found.digest[pick], found.anchor[pick], keys[pick]
    at = np.flatnonzero(np.concatenate(([True], (digest[1:] != digest[:-1]) | (anchor[1:] != anchor[:-1]))))
    owner = doc[np.searchsorted(ends, found.start[pick], "right")]
    low, high = np.minimum.reduceat(owner, at), np.maximum.reduceat(owner, at)
    start, size = found.start[pick[at]], (found.end - found.start)[pick[at]]
    bucket = (key[at] >> U(32)).astype(np.int32)
    short = key[at].astype(np.uint32)
    raw = memoryview(np.ascontiguousarray(data))
    border = _bounds(bucket)
    g = table.column("g")[0].as_py()
    rows = []
    for a, b in zip(border, border[1:]):
        text = b"".join([raw[s : s + n] for s, n in zip(start[a:b].tolist(), size[a:b].tolist())])
        numbers = (size[a:b].astype(np.uint16), digest[at[a:b]], short[a:b])
        several = low[a:b] < high[a:b]  # few have a second number
        rows.append((bucket[a], g, text, *(x.tobytes() for x in numbers), _narrow(low[a:b]), np.packbits(several).tobytes(), _narrow(high[a:b][several])))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SENT)], schema=SENT)


@dataclass(frozen=True)
class Groups:
    """Maximal repeat groups: occurrences (string, start, end) of each, and its least doc_id."""

    string: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def repeat_groups(rows: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, rule: Rule) -> Groups:
    """All maximal repeats of `least` bytes or more among distinct strings (rows of bytes, padded), with every occurrence.

    The suffixes that begin with a window that several strings hold are sorted; neighbours'
    common prefixes make the tree of intervals, which a stack visits bottom-up. An interval is
    a maximal repeat if its occurrences are preceded by different bytes (the begin of a string
    differs from all): else a longer repeat, one byte to the left, has the same occurrences.
    `low` and `high` are the least and largest doc_id of each string; groups of one doc_id are
    left out. A string that several doc_ids have is a group of its own.
    """
    k, width = rule.least, rows.shape[1]
    alone = np.flatnonzero(low < high)
    out = [(alone, np.zeros(len(alone), np.int64), sizes[alone], low[alone])]
    # windows that occur in two strings, or twice in one
    flat = rows.ravel()
    starts = np.repeat(np.arange(len(rows)) * width, sizes - k + 1) + _ranges(sizes - k + 1)
    hashes = np.empty(len(starts), np.uint64)
    step = max(1, CHUNK // width) * width
    for a in range(0, len(flat), step):
        b = min(a + step, len(flat))
        i, j = np.searchsorted(starts, [a, b])
        if i < j:
            hashes[i:j] = _substrings(flat[a:b], k)[starts[i:j] - a]
    order = np.argsort(hashes, kind="stable")
    line = hashes[order]
    again = np.zeros(len(line), bool)
    again[1:] = line[1:] == line[:-1]
    again[:-1] |= again[1:]
    starts = np.sort(starts[order[again]])
    if len(starts):
        string, at = starts // width, starts % width
        length = sizes[string] - at
        wide = -(-width // 8) * 8
        padded = np.concatenate((flat, np.zeros(wide, np.uint8)))
        suffix = padded[starts[:, None] + np.arange(wide)]
        suffix[np.arange(wide) >= length[:, None]] = 0
        words = suffix.view(">u8").astype(np.uint64)
        order = np.lexsort((length, *words.T[::-1]))  # zeros pad, so of equal ones the shorter comes first
        suffix, string, at, length = suffix[order], string[order], at[order], length[order]
        differ = suffix[1:] != suffix[:-1]
        shared = np.where(differ.any(1), differ.argmax(1), wide)
        shared = np.minimum(shared, np.minimum(length[1:], length[:-1]))
        left = np.where(at > 0, padded[starts[order] - 1].astype(np.int64), -1)
        spans = _intervals(shared.tolist(), low[string].tolist(), high[string].tolist(), left.tolist(), k)
        if spans:
            lo, hi, size, first = (np.array(c, np.int64) for c in zip(*spans))
            place = np.repeat(lo, hi - lo + 1) + _ranges(hi - lo + 1)
            size, first = np.repeat(size, hi - lo + 1), np.repeat(first, hi - lo + 1)
            useful = first < high[string[place]]
            place, size, first = place[useful], size[useful], first[useful]
            out.append((string[place], at[place], at[place] + size, first))
    return Groups(*(np.concatenate(c) for c in zip(*out)))


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _intervals(shared: list[int], low: list[int], high: list[int], left: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """(first, last, common prefix, least doc_id) of the intervals that are maximal repeats of more than one doc_id."""
    found, stack = [], []  # of [common prefix, first suffix, least and largest doc_id, byte on the left or -1 where that varies]
    n = len(low)
    for i in range(n):
        l = shared[i] if i + 1 < n else 0  # noqa: E741
        begin, a, b, c = i, low[i], high[i], left[i]
        while stack and stack[-1][0] > l:
            prefix, begin, x, y, z = stack.pop()
            a, b, c = min(a, x), max(b, y), c if c == z else -1
            if c == -1 and a < b:
                found.append((begin, i, prefix, a))
        if stack and stack[-1][0] == l:
            top = stack[-1]
            top[2], top[3] = min(a, top[2]), max(b, top[3])
            if top[4] != c:
                top[4] = -1
        elif l >= least:
            stack.append([l, begin, a, b, c])
    return found


FOUND = pa.schema([("g", pa.int32()), ("digests", pa.binary()), ("shorts", pa.binary()), ("start", pa.binary()), ("end", pa.binary()), ("first", pa.binary())])
FOUND_DDL = "g int, digests binary, shorts binary, start binary, end binary, first binary"


def _found(table: pa.Table, rule: Rule) -> pa.Table:
    """The maximal repeats of one bucket; each group of texts gets the occurrences in its segments."""
    read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
    sizes, digests, shorts = read("sizes", np.uint16).astype(np.int64), read("digests", np.uint64), read("shorts", np.uint32)
    data, counts = read("data", np.uint8), np.array([len(x) // 2 for x in table.column("sizes").to_pylist()])
    low = np.concatenate([_widened(x, n) for x, n in zip(table.column("low").to_pylist(), counts)])
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(table.column("several").to_pylist(), counts)]
    high = low.copy()
    high[np.concatenate(several)] = np.concatenate([_widened(x, np.count_nonzero(s)) for x, s in zip(table.column("high").to_pylist(), several)])
    offset, width = np.cumsum(sizes) - sizes, int(sizes.max())
    # equal segments of several groups become one
    order = np.argsort(digests, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = (digests[order[1:]] == digests[order[:-1]]) & (sizes[order[1:]] == sizes[order[:-1]])
    for i in np.array_split(np.flatnonzero(same), -(-len(order) // 100_000)):  # the bytes decide
        a, b, n = offset[order[i]], offset[order[i - 1]], sizes[order[i]]
        for s in range(0, width):
            inside = np.flatnonzero(n > s)
            same[i[inside[data[a[inside] + s] != data[b[inside] + s]]]] = False
    number = np.cumsum(~same) - 1
    at = np.flatnonzero(~same)
    of = np.empty(len(order), np.int64)
    of[order] = number
    head = order[at]
    rows = np.zeros((len(head), width), np.uint8)
    inside = np.repeat(np.arange(len(head)) * width, sizes[head]) + _ranges(sizes[head])
    rows.ravel()[inside] = data[np.repeat(offset[head], sizes[head]) + _ranges(sizes[head])]
    groups = repeat_groups(rows, sizes[head], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at), rule)
    line = np.argsort(groups.string, kind="stable")
    times = np.bincount(groups.string, minlength=len(head))
    begin = np.cumsum(times) - times
    # every group's segments, each with all its occurrences
    mine = np.repeat(np.arange(len(of)), times[of])
    occurrence = line[np.repeat(begin[of], times[of]) + _ranges(times[of])]
    useful = groups.first[occurrence] < high[mine]
    mine, occurrence = mine[useful], occurrence[useful]
    message = np.repeat(np.arange(len(counts)), counts)[mine]
    border = _bounds(message)
    g = table.column("g").to_pylist()
    columns = (digests[mine], shorts[mine], groups.start[occurrence].astype(np.uint16), groups.end[occurrence].astype(np.uint16))
    first = groups.first[occurrence]
    made = [(g[message[a]], *(c[a:b].tobytes() for c in columns), _narrow(first[a:b])) for a, b in zip(border, border[1:])]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), FOUND)], schema=FOUND) if made else FOUND.empty_table()


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
KEPT_DDL = "doc_id long, n_bytes long, kept binary, starts array<long>, ends array<long>"


def _kept(table: pa.Table, found: pa.Table, rule: Rule) -> pa.Table:
    """What is left of each text of a group, and the spans that went."""
    if not table.num_rows:
        return KEPT.empty_table()
    data, ends, doc = _laid_out(table)
    level = np.zeros(len(data) + 1, np.int32)
    if found.num_rows:
        read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in found.column(name).to_pylist()])
        columns = [read(*c) for c in (("digests", np.uint64), ("shorts", np.uint32), ("start", np.uint16), ("end", np.uint16))]
        columns.append(np.concatenate([_widened(x, len(y) // 2) for x, y in zip(found.column("first").to_pylist(), found.column("start").to_pylist())]))
        order = np.lexsort(columns[:2])
        digest, short, start, end, first = (c[order] for c in columns)
        own = segments(data, ends, rule, with_digest=True)
        mine = (own.anchor >> U(32)).astype(np.uint32)
        at = np.flatnonzero(np.concatenate(([True], (short[1:] != short[:-1]) | (digest[1:] != digest[:-1]))))
        times = np.diff(np.concatenate((at, [len(digest)])))
        near = np.flatnonzero(np.isin(own.digest, digest))
        ranks = {(s, d): i for i, (s, d) in enumerate(zip(short[at].tolist(), digest[at].tolist()))}
        rank = np.fromiter((ranks.get(key, -1) for key in zip(mine[near].tolist(), own.digest[near].tolist())), np.int64, len(near))
        near, rank = near[rank >= 0], rank[rank >= 0]
        each = np.repeat(near, times[rank])
        place = np.repeat(at[rank], times[rank]) + _ranges(times[rank])
        later = first[place] < doc[np.searchsorted(ends, own.start[each], "right")]
        each, place = each[later], place[later]
        level += np.bincount(own.start[each] + start[place], minlength=len(level)).astype(np.int32)
        level -= np.bincount(own.start[each] + end[place], minlength=len(level)).astype(np.int32)
    gone = np.cumsum(level)[:-1] > 0
    begins = np.concatenate(([0], ends[:-1]))
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = gone[1:] != gone[:-1]
    edge[begins] = edge[ends] = True  # spans of neighbouring texts stay apart
    edges = np.flatnonzero(edge)
    if len(edges) > 1:
        a, b = edges[:-1], edges[1:]
        a, b = a[gone[a]], b[gone[edges[:-1]]]
    else:
        a = b = np.empty(0, np.int64)
    cut = np.searchsorted(a, np.concatenate((begins, [len(data)])))
    rows = []
    for i, doc_id in enumerate(table.column("doc_id").to_pylist()):
        s, e = begins[i], ends[i]
        x = slice(cut[i], np.searchsorted(a, e))
        rows.append((doc_id, e - s, data[s:e][~gone[s:e]].tobytes(), (a[x] - s).tolist(), (b[x] - s).tolist()))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), KEPT)], schema=KEPT)


def remove_repeats(docs: DataFrame, rule: Rule = Rule(), groups: int | None = None, buckets: int | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, kept, starts, ends: texts as UTF-8 without what documents of smaller doc_id have too.

    A byte goes if a string of `least` bytes that covers it also stands in a document with a
    smaller doc_id; starts and ends are the maximal spans that went, in bytes of the whole text.
    Strings are judged on the input, so a span may go although the earlier document loses it too.

    Windows of `least` bytes are dealt out by the smallest hash of the grams in them: equal
    windows meet in one bucket, as parts of segments of at most `longest` bytes. Texts are
    shuffled once, to groups by hash, which each step reads again:
    1. groups offer 32 bits of each anchor, once; buckets answer one bit: is it in several texts;
    2. groups send the distinct segments of these anchors; buckets sort their suffixes and return
       the maximal repeats with all occurrences;
    3. groups mark what lies in a repeat whose least doc_id is smaller than the text's own.
    Copies are counted once in their group and once in the bucket, so that none makes a hot
    bucket: what a bucket holds of one anchor grows with the number of groups, not of copies.
    Equal segments are told by 96 bits of hash within a group and by their bytes in a bucket.

    Null text is empty. Rows that share a doc_id do not remove from each other; rows without
    doc_id stand behind all others and do not remove from each other either. Other columns are
    not read; an empty table gives no row. A text is held whole by one task.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups, buckets = groups or max(2 * n, size // GROUP_BYTES), buckets or max(n, size // BUCKET_BYTES)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")).groupBy("g")
    offers = texts.applyInArrow(lambda t: _offered(t, rule, buckets), OFFERS_DDL)
    answers = offers.groupBy("bucket").applyInArrow(lambda t: _answered(t), ANSWERS_DDL)
    sent = texts.cogroup(answers.groupBy("g")).applyInArrow(lambda t, a: _sent(t, a, rule, buckets), SENT_DDL)
    found = sent.groupBy("bucket").applyInArrow(lambda t: _found(t, rule), FOUND_DDL)
    return texts.cogroup(found.groupBy("g")).applyInArrow(lambda t, f: _kept(t, f, rule), KEPT_DDL)


ORACLE = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS (SELECT doc_id, p, b[p + 1:p + 50] AS w FROM (SELECT *, unnest(range(n - 49)) AS p FROM docs WHERE n >= 50)),
hits AS (SELECT doc_id, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY w) AS low FROM starts) WHERE low < doc_id),
steps AS (SELECT *, CASE WHEN p <= 50 + lag(p) OVER (PARTITION BY doc_id ORDER BY p) THEN 0 ELSE 1 END AS fresh FROM hits),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM steps) GROUP BY doc_id, k),
cuts AS (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(e ORDER BY a) AS ends FROM spans GROUP BY doc_id),
parts AS (SELECT doc_id, n, n_removed, n_spans, b, unnest(list_zip(list_prepend(0, coalesce(ends, [])), list_append(coalesce(starts, []), n))) AS part FROM docs LEFT JOIN cuts USING (doc_id))
SELECT doc_id, any_value(n) AS n_bytes, CAST(coalesce(any_value(n_removed), 0) AS BIGINT) AS n_removed, coalesce(any_value(n_spans), 0) AS n_spans,
  sha256(from_hex(coalesce(string_agg(hex(b[part[1] + 1:part[2]]), '' ORDER BY part[1]), ''))) AS kept_sha256 FROM parts GROUP BY doc_id
"""
