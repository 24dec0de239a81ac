import hashlib
import random
import re

import pytest

from gridloom.llm import mixing as M


def brute_targets(sizes, weights=(1, 2, 3), most=3.0):
    """Share by weight; whatever is above a cap is fixed there and shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_to = {}, float(sum(sizes.values())), set(order)
    while open_to:
        total = sum(weight[s] for s in open_to)
        over = [s for s in open_to if left * weight[s] / total >= most * sizes[s]]
        if not over:
            target.update({s: left * weight[s] / total for s in open_to})
            break
        for s in over:
            target[s] = most * sizes[s]
            open_to.remove(s)
        left -= sum(most * sizes[s] for s in over)
    return target


def brute(rows):
    """Rows are taken in order of hash until half of the next one would not fit, counted one by one."""
    units = []
    for i, t, _, s in rows:
        own = ("n" if i is None else str(i)) + ":" + ("n" if t is None else hashlib.md5(t.encode()).hexdigest())
        units.append((i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), int(hashlib.md5(own.encode()).hexdigest()[:15], 16)))
    sizes = {}
    for _, s, n, _ in units:
        sizes[s] = sizes.get(s, 0) + n
    target = brute_targets(sizes)
    out = []
    for source in sizes:
        whole = min(3, int(target[source] / sizes[source])) if sizes[source] else 0
        budget, at = target[source] - whole * sizes[source], 0
        for i, _, n, _ in sorted((u for u in units if u[1] == source), key=lambda u: u[3]):
            out.append((i, n, sizes[source], target[source], n * (whole + (budget > 0 and at + n / 2 <= budget))))
            at += n
    return out


def compare(df, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[4])
    got = sorted((tuple(r) for r in df.drop("copies").collect()), key=key)
    expected = sorted(brute(rows), key=key)
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in expected])
    assert [r[4] for r in got] == [r[4] for r in expected]


def corpus(seed, sources=7, n=300):
    rng = random.Random(seed)
    hot = lambda: rng.choice(["s0", f"s{rng.randrange(sources)}"])
    return [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40, 500])), None, hot()) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_brute_force(docs_of, seed):
    rows = corpus(seed) + [(5000, None, None, "s1"), (5001, "a\x0bb\u00a0c \t d", None, None), (None, "x y", None, "s2"), (None, "x y z", None, "s2"), (5002, "", None, "empty")]
    got = M.mix_sources(docs_of(rows))
    compare(got, rows)
    found = got.collect()
    by = {}
    for r in found:
        assert r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], round(r["target"], 6)), []).append(r)
    for (_, target), rs in by.items():
        assert abs(sum(r["taken"] for r in rs) - target) <= max(r["size"] for r in rs) + 5
    assert {tuple(r) for r in M.mix_sources(docs_of(rows)).collect()} == {tuple(r) for r in found}


def test_edges(docs_of):
    assert M.mix_sources(docs_of([])).count() == 0
    for rows in ([(1, None, None, None)], [(1, "a b", None, "s")], [(1, "a b", None, "s"), (1, "a b", None, "s")], [(i, "w " * 5, None, f"s{i:03}") for i in range(40)]):
        compare(M.mix_sources(docs_of(rows)), rows)


@pytest.mark.parametrize("doc_id, equal", [(None, False), (7, True)])
def test_rows_of_one_doc_id(docs_of, doc_id, equal):
    """Null, repeated and wholly equal rows are not taken all or none."""
    rows = [(doc_id, "w " * 5 if equal else f"{i} " + "w " * (i % 9), None, f"s{i % 3}") for i in range(600)]
    docs = docs_of(rows).repartition(7)
    compare(M.mix_sources(docs), rows)
    sums = {}
    for r in M.mix_sources(docs).collect():
        sums.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(taken) - target) <= 4.5 for (_, target), taken in sums.items())
    got = M.mixed_documents(docs).groupBy("source").agg({"text": "count"}).collect()
    expected = {}
    for r, row in zip(brute(sorted(rows, key=lambda r: r[3])), sorted(rows, key=lambda r: r[3])):
        expected[row[3]] = expected.get(row[3], 0) + (r[4] // r[1])
    assert {r[0]: r[1] for r in got} == expected


def test_larger_targets_include_smaller_ones(docs_of):
    rows = [(i, "w " * (i % 9 + 1), None, "a") for i in range(200)] + [(1000 + i, "w " * 5, None, "b") for i in range(200)]
    taken = lambda weights: {r["doc_id"] for r in M.mix_sources(docs_of(rows), weights).where("copies > 0 and doc_id < 1000").collect()}
    assert taken((1, 9)) < taken((1, 4)) < taken((1, 2))


def test_mixed_documents(docs_of):
    rows = corpus(3) + [(None, "x y", "en", "s2")]
    docs = docs_of(rows)
    copies = {}
    for r in M.mix_sources(docs).collect():
        copies[r["doc_id"]] = r["copies"]
    got = M.mixed_documents(docs)
    assert got.columns == docs.columns
    counts = {}
    for r in got.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts == {k: v for k, v in copies.items() if v}
    clash = docs_of([(1, "a b", "s", 9, 8, "c", 7)], "doc_id long, text string, source string, copies long, d long, cell string, __copies long")
    assert M.mixed_documents(clash).columns == clash.columns and M.mixed_documents(clash).collect() == clash.collect()
