import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from gridloom.llm import fingerprints as P

WORDS = [f"w{i}x" for i in range(500)]


def prose(seed, n=400):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def test_chunks_cover_and_keep_limits():
    rule = P.Chunking()
    texts = [b"", b"a", prose(1).encode(), b"z" * 5000, "é漢".encode() * 999]
    for text, ends in zip(texts, P.chunk_ends(texts, rule)):
        ends = ends.tolist()
        assert (ends[-1] if ends else 0) == len(text)
        sizes = [e - s for s, e in zip([0, *ends[:-1]], ends)]
        assert all(size <= rule.most for size in sizes) and all(size >= rule.least for size in sizes[:-1])


def test_chunks_depend_on_the_text_alone():
    texts = [prose(i).encode() for i in range(5)]
    together = P.chunk_ends(texts)
    for text, ends in zip(texts, together):
        assert P.chunk_ends([text])[0].tolist() == ends.tolist()


def test_boundaries_by_a_plain_loop():
    rule, text = P.Chunking(), prose(9, 2000).encode()
    ends, start, h = [], 0, 0
    hashes = []
    for b in text:
        h = ((h << 1) + int(P.GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    while start < len(text):
        cut = min(start + rule.most, len(text))
        for i in range(start + rule.least - 1, min(start + rule.most, len(text))):
            bits = rule.hard if i + 1 <= start + rule.normal and hashes[i] >> (32 - rule.hard) == 0 else rule.easy
            if i + 1 < start + rule.normal and bits == rule.easy:
                continue
            if hashes[i] >> (32 - bits) == 0:
                cut = i + 1
                break
        ends.append(cut)
        start = cut
    assert P.chunk_ends([text], rule)[0].tolist() == ends


def test_insertions_shift_nothing_else():
    text = prose(2, 3000)
    a, b = P.chunk_sets([text.encode(), ("some new words in front " + text).encode()])
    assert P.containment(a, b) > 0.95
    assert P.decoded(P.encoded(a)) == dict(sorted(a.items()))
    assert P.containment({}, {}) == 1 and P.containment(a, {}) == 0 and P.containment({}, a) == 0


def brute(rows):
    tie = lambda text: (xxhash.xxh64_intdigest(text.encode(), 42) ^ 1 << 63, text)  # signed order
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), *tie(r[1] or "")))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 2
        edited = text[: len(text) - k] + after[:k]
        own, new, far = P.chunk_sets([text.encode(), edited.encode(), after.encode()])
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), P.encoded(own), P.encoded(new), P.containment(own, new), P.containment(own, far)))
    return out


def test_query_against_brute_force(docs_of):
    rows = [(i * 3 % 101, prose(i, i * 7 % 90)) for i in range(101)] + [(500, None), (501, ""), (502, "x" * 70_000), (503, "ä" * 999)]
    for ranges in (1, 7, 300):
        got = P.fingerprint_documents(docs_of(rows), ranges=ranges).collect()
        assert sorted(tuple(r)[:7] for r in got) == sorted(brute(rows))


def test_hot_doc_ids_are_split(docs_of):
    rows = [(None, prose(i, 5 + i % 9)) for i in range(120)] + [(7, prose(500 + i, 5 + i % 9)) for i in range(120)] + [(i, prose(900 + i, 8)) for i in range(120)]
    rows += [(-(2**63), "least"), (2**63 - 1, "largest"), (7, None), (None, None), (None, "")]
    for ranges in (1, 24):
        frame = P.fingerprint_documents(docs_of(rows), ranges=ranges)
        assert sorted(map(str, (tuple(r)[:7] for r in frame.collect()))) == sorted(map(str, brute(rows)))
    sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * len(rows) / len(sizes)


def test_plans_do_not_grow_with_ranges(docs_of):
    import time

    docs = docs_of([(i * 7 % 3001, "w") for i in range(3001)])
    P.fingerprint_documents(docs, ranges=50)
    began = time.perf_counter()
    made = P.fingerprint_documents(docs, ranges=20_000)
    made._jdf.queryExecution().optimizedPlan()
    assert time.perf_counter() - began < 15
    assert made.count() == 3001


def test_edges(docs_of):
    assert P.fingerprint_documents(docs_of([])).count() == 0
    (one,) = P.fingerprint_documents(docs_of([(1, prose(1))])).collect()
    assert one["near_edited"] <= 1 and one["near_next"] == 1
    rows = [(None, "a b c"), (4, "same text"), (4, "same text"), (2, None)]
    got = P.fingerprint_documents(docs_of(rows), ranges=3).collect()
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(map(str, brute(rows)))
    clash = docs_of([(1, "t", "e")], "doc_id long, text string, span string")
    assert P.fingerprint_documents(clash).count() == 1
