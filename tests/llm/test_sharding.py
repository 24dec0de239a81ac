import random
import zlib
from collections import Counter, defaultdict

import pytest

from gridloom.llm import sharding as S


def check(rows, got, shards=8):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    assert all(r["law"] == "rows" and 0 <= r["shard"] < shards and r["grown_shard"] is None for r in got)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values(), default=0) - min((counts.get(s, 0) for s in range(shards)), default=0) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def cut(rows, got):
    """Groups in more shards than their size needs."""
    text = dict(rows)
    groups = defaultdict(set)
    sizes = Counter(text[r["doc_id"]] for r in got)
    for r in got:
        groups[text[r["doc_id"]]].add(r["shard"])
    return sum(len(v) > -(-sizes[t] * 8 // len(got)) for t, v in groups.items())


def test_groups_stay_together(docs_of):
    rng = random.Random(1)
    rows = [(i, f"text {rng.randrange(300)}" if i % 3 else f"alone {i}") for i in range(1200)]
    got = S.shard_documents(docs_of(rows)).collect()
    check(rows, got)
    assert cut(rows, got) <= 8


def test_a_third_of_all_rows_are_copies(docs_of, monkeypatch):
    monkeypatch.setattr(S, "LEAST_SHARE", 50)
    rows = [(i, "hot" if i % 3 == 0 else f"text {i // 2}") for i in range(900)]
    got = S.shard_documents(docs_of(rows)).collect()
    check(rows, got)
    assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"hot")}) <= 8
    assert cut([r for r in rows if r[1] != "hot"], [r for r in got if r["doc_id"] % 3]) <= 16


def plain_propagation(rows, quotas, rounds, tie):
    """The same rounds over a list of dicts, one row at a time."""
    rows = [dict(r) for r in rows]
    for _ in range(rounds):
        counts = Counter((r["group"], r["label"]) for r in rows)
        wish = {}
        for (group, label), c in counts.items():
            wish[group] = max(wish.get(group, (0,)), (c, tie[group, label], label))
        demand = Counter((r["label"], wish[r["group"]][2]) for r in rows)
        loads = Counter(r["label"] for r in rows)
        moves = {}
        for (a, b), n in demand.items():
            if a != b:
                moves[a, b] = min(n, demand.get((b, a), 0))
        for b, quota in enumerate(quotas):
            room = max(quota - loads[b], 0)
            for a in range(len(quotas)):
                if a != b and (a, b) in moves:
                    more = max(min(demand[a, b] - moves[a, b], room), 0)
                    moves[a, b] += more
                    room -= more
        if not any(moves.values()):
            break
        done = Counter()
        for r in sorted(rows, key=lambda r: (r["group"] % S.CELLS, r["group"], r["h"])):
            pair = (r["label"], wish[r["group"]][2])
            if pair[0] != pair[1] and done[pair] < moves.get(pair, 0):
                done[pair] += 1
                r["label"] = pair[1]
    return {r["row"]: r["label"] for r in rows}


@pytest.mark.parametrize("seed, rounds", [(1, 1), (2, 6)])
def test_propagation_against_plain_python(spark, seed, rounds):
    rng = random.Random(seed)
    groups = [rng.randrange(-(2**62), 2**62) for _ in range(40)]
    rows = [{"group": rng.choice(groups[: rng.choice([3, 40])]), "label": rng.randrange(4), "h": rng.randrange(2**60), "row": i} for i in range(400)]
    sizes = Counter(r["group"] for r in rows)
    full = [{**r, "n": sizes[r["group"]], "share": 1000, "doc_id": r["row"], "text_crc32": 0} for r in rows]
    schema = "group long, label int, h long, row long, n long, share int, doc_id long, text_crc32 long"
    pairs = spark.createDataFrame([(g, k) for g in groups for k in range(4)], "group long, label int").selectExpr("group", "label", "xxhash64(group, label) as t")
    tie = {(r["group"], r["label"]): r["t"] for r in pairs.collect()}
    quotas = [100, 120, 90, 90]
    got = S.propagate(spark.createDataFrame(full, schema), quotas, rounds)
    assert {r["row"]: r["label"] for r in got.collect()} == plain_propagation(rows, quotas, rounds, tie)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 20])
def test_small_tables(docs_of, n):
    rows = [(i, "same") for i in range(n)]
    check(rows, S.shard_documents(docs_of(rows)).collect())


def test_edges(docs_of):
    rows = [(None, None), (None, ""), (3, "ä" * 10_000), (3, "ä" * 10_000), (3, "other"), (4, "é")]
    check(rows, S.shard_documents(docs_of(rows)).collect())
    assert S.shard_documents(docs_of([(1, "t", 2)], "doc_id long, text string, shard long")).count() == 1
