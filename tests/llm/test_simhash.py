import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import simhash as S
from gridloom.llm.components import connected_components


def plain(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in ("", None, " \t\n", "One", "one Two", "A b c", "é É x y\x1cz", "the cat sat on the mat " * 40):
        assert S.fingerprint(text) == plain(text)


def test_position_sets():
    for matches, taken in ((5, 3), (5, 4), (5, 5), (6, 3)):
        sets = S.position_sets(matches, taken)
        from itertools import combinations

        assert all(any(set(s) <= set(m) for s in sets) for m in combinations(range(8), matches))
    assert len(S.position_sets(5, 3)) == 8


def brute(prints):
    """doc index -> smallest index reachable."""
    least = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if bin(prints[i] ^ prints[j]).count("1") <= 3 and least[j] < least[i]:
                    least[i], changed = least[j], True
    return least


def test_links_of_random_and_dense_fingerprints(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for base in prints[:12]:
        for _ in range(10):
            x = base
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    dense = rng.getrandbits(64)
    prints += [dense ^ v for v in range(200)]  # one long posting list
    prints = list(dict.fromkeys(prints))
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    expected = brute(prints)
    groups = {}
    for i, low in enumerate(expected):
        groups.setdefault(low, set()).add(signed[i])
    for size in (4096, 20):  # whole lists, and lists dealt out in cells
        links = S.fingerprint_links(fps, list_size=size)
        found = {}
        for r in connected_components(links).collect():
            found.setdefault(r["root"], set()).add(r["node"])
        assert {frozenset(g) for g in found.values()} == {frozenset(g) for g in groups.values() if len(g) > 1}
        assert links.count() < 40 * len(prints)


def test_long_lists_are_posted_under_more_positions(spark):
    rng = random.Random(9)
    shared = [rng.randrange(256) for _ in range(3)]
    prints = []
    for _ in range(150):  # three bytes in common, five at random, and near copies of some
        x = int.from_bytes(bytes([*shared, *(rng.randrange(256) for _ in range(5))]), "little")
        prints += [x, *(x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(rng.randrange(3)))]
    prints = list(dict.fromkeys(prints))
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    least = brute(prints)
    groups = {}
    for i, low in enumerate(least):
        groups.setdefault(low, set()).add(signed[i])
    links = S.fingerprint_links(fps, list_size=16)
    found = {}
    for r in connected_components(links).collect():
        found.setdefault(r["root"], set()).add(r["node"])
    assert {frozenset(g) for g in found.values()} == {frozenset(g) for g in groups.values() if len(g) > 1}


def test_components_of_a_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected_components(links).collect()
    assert len(got) == 301 and {r["root"] for r in got} == {0}
    assert connected_components(links.limit(0)).count() == 0


def corpus():
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    rows = [(10 * i, " ".join(rng.choices(words, k=rng.randint(1, 120)))) for i in range(60)]
    rows += [(7 + 10 * i, rows[5][1]) for i in range(40)]  # exact copies
    long = rng.choices(words, k=400)
    for i in range(25):  # near copies
        copy = list(long)
        copy[rng.randrange(400)] = "changed"
        rows.append((5000 + i, " ".join(copy)))
    return rows + [(9001, ""), (9000, None), (9002, " \n ")]


def test_query_against_brute_force(docs_of):
    rows = corpus()
    got = {r["doc_id"]: r for r in S.near_duplicates(docs_of(rows)).collect()}
    rows.sort(key=lambda r: r[0])
    prints = [plain(t) for _, t in rows]
    expected = brute(prints)
    assert len(got) == len(rows)
    for (doc_id, _), fp, low in zip(rows, prints, expected):
        assert got[doc_id]["fingerprint"] % 2**64 == fp and got[doc_id]["component_id"] == rows[low][0]


def test_one_of_each(docs_of):
    rows = corpus()
    kept = {r["doc_id"] for r in S.one_of_each(docs_of(rows)).collect()}
    expected = {r["component_id"] for r in S.near_duplicates(docs_of(rows)).collect()}
    assert kept == expected
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "q w e r t y"), (2, "x y z u v"), (None, "x y z u v")]
    kept = S.one_of_each(docs_of(rows))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2] or sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 2]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert S.near_duplicates(docs_of([])).count() == 0
    clash = docs_of([(1, "t", 5)], "doc_id long, text string, fingerprint long")
    assert S.one_of_each(clash).count() == 1


def test_one_of_each_group(docs_of):
    a, b, c, d = ("one two three four five", "red green blue white black", "q w e r t y", "x y z u v w")
    rows = [(1, b), (1, a), (2, b), (3, a), (None, c), (None, c), (None, a), (None, d), (4, "m n o p"), (4, "m n o p")]
    kept = S.one_of_each(docs_of(rows))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, c), (0, d), (1, a), (1, b), (4, "m n o p")]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_long_texts_by_arrays(monkeypatch):
    texts = ["", " ", "\t\n", "a", " a ", "a  b\x0b\x0cc\r d", "é  \u00a0 x\x1cy A B", " ".join(f"W{i % 97}" for i in range(9000)) + "  "]
    expected = [S.fingerprint(t) for t in texts]
    monkeypatch.setattr(S, "LONG", -1)
    assert [S.fingerprint(t) for t in texts] == expected


def test_columns_of_any_name(docs_of):
    names = "id fp node root component rows first row __id __fp __root __copy fingerprint component_id".split()
    rows = [(None, "one two three", *range(14)), (None, "one two three", *range(14)), (4, "x y z w", *range(14)), (4, "other words are here", *range(14)), (5, "x y z w", *range(14))]
    docs = docs_of(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, (rows[0], rows[2], rows[3])))
