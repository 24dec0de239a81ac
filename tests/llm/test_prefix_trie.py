import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gridloom.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, digest(role, text)[:32], role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(head, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    facts = {}
    for node in sorted(members, key=len, reverse=True):
        below = [facts[c] for c in children[node]]
        size = len(node[-1][1].encode()) if node else 0
        facts[node] = (sum(f[0] for f in below) or 1, sum(f[1] for f in below) + (len(members[node]) - 1) * size)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if paths[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), *facts[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def found(table, **options):
    return sorted(str(tuple(r)) for r in P.prefix_trie(table, **options).collect())


def talks(seed, convs=120, texts=3):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "c é", ""][:texts])) for c in range(convs) for t in range(rng.randrange(7))]


def test_merge_gives_order_and_shared_turns():
    rng = random.Random(1)
    cell = lambda: bytes([rng.randrange(2)]) * P.CELL
    paths = list({b"".join(cell() for _ in range(rng.randrange(9))) for _ in range(400)})
    for k in (1, 2, 3, 7, 30, 500):
        runs, cut = [], sorted(rng.choices(range(len(paths)), k=k - 1))
        for a, b in zip([0, *cut], [*cut, len(paths)]):
            order, shared = P.sorted_run(paths[a:b])
            runs.append(([paths[a:b][i] for i in order], shared))
        got = [(runs[i][0][j], n) for i, j, n in P.merged_runs(runs)]
        assert [p for p, _ in got] == sorted(paths)
        assert [n for _, n in got] == [0, *(P.common(a, b) for a, b in zip(sorted(paths), sorted(paths)[1:]))]
    assert list(P.merged_runs([])) == [] == list(P.merged_runs([([], [])]))


@pytest.mark.parametrize("range_bytes", [P.RANGE_BYTES, 2000, 300])
def test_trie_against_plain_python(spark, range_bytes):
    rows = talks(3) + [(-7, 0, "user", "a"), (10**15, 5, "user", "bb"), (10**15, None, "user", "a")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(table, range_bytes=range_bytes) == brute(rows)


def test_ranges_cut_through_long_equal_beginnings(spark, monkeypatch):
    monkeypatch.setattr(P, "CUT_TURNS", 30)
    monkeypatch.setattr(P, "RUN_BYTES", 4000)
    rng = random.Random(8)
    rows = [(c, t, "user", "same" if t < 20 or rng.random() < 0.6 else str(rng.randrange(3))) for c in range(90) for t in range(rng.randrange(15, 30))]
    assert found(spark.createDataFrame(rows, SCHEMA), range_bytes=1500) == brute(rows)


def test_many_equal_conversations_are_listed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "LISTED", 7)
    rows = [(c, t, "user", "hello") for c in range(-60, 200) for t in range(2)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_edges(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [(None, 1, "user", "x"), (5, None, None, None), (5, 1, "user", "é"), (5, 1, "user", "é"), (6, 1, "", ""), (7, 0, "user", "z" * 300_000)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    turnless = [(c, 0, "user", "x") for c in range(1, 60) if c % 5]
    assert found(spark.createDataFrame(turnless, SCHEMA)) == brute(turnless)
    clash = spark.createDataFrame([(1, 0, "user", "a", "k", b"p")], SCHEMA + ", head string, path binary")
    assert found(clash) == brute([(1, 0, "user", "a")])
