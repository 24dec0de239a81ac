import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import repeats as R


def brute(rows, k=50):
    first = {}
    order = lambda d: R.LAST if d is None else d
    texts = [(order(d), (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - k + 1):
            first[t[i : i + k]] = min(d, first.get(t[i : i + k], d))
    out = []
    for (doc_id, _), (d, t) in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - k + 1):
            if first[t[i : i + k]] < d:
                gone[i : i + k] = b"\1" * k
        spans = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        kept = bytes(b for b, x in zip(t, gone) if not x)
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def found(table, rule=R.Rule(), **options):
    made = R.remove_repeats(table, rule, **options)
    return sorted(str(tuple(r)) for r in summed(made).collect())


def summed(made):
    return made.select("doc_id", "n_bytes", F.expr("n_bytes - length(kept)"), F.size("starts"), F.sha2("kept", 256))


def corpus(seed, n=60, alphabet="ab é"):
    """Few letters, so that repeats of all sizes arise, and pieces copied between documents with edits."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        text = "".join(rng.choices(alphabet, k=rng.choice([0, 3, 60, 200])))
        for _ in range(rng.randrange(4)):
            if texts:
                source = rng.choice(texts)
                a = rng.randrange(len(source) + 1)
                at = rng.randrange(len(text) + 1)
                text = text[:at] + source[a : a + rng.randrange(150)] + text[at:]
        texts.append(text)
    ids = rng.sample(range(-50, 1000), n)
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed,groups,buckets", [(1, None, None), (2, 1, 1), (3, 40, 7)])
def test_removal_against_brute_force(docs_of, seed, groups, buckets):
    rows = corpus(seed)
    assert found(docs_of(rows), groups=groups, buckets=buckets) == brute(rows)


def test_short_rules_meet_many_repeats(docs_of):
    rows = corpus(4, 40, "ab")
    for least, gram in ((8, 3), (5, 4), (20, 1)):
        assert found(docs_of(rows), R.Rule(least, gram), groups=5, buckets=3) == brute(rows, least)


def test_runs_nulls_copies_and_shared_ids(docs_of):
    passage = "".join(random.Random(6).choices("abcdefgh \n", k=400))
    rows = [(i, passage) for i in range(40)] + [(7, "x" + passage[:80]), (7, passage[100:300]), (7, passage[100:300]), (None, passage[:49]), (None, passage[:50]), (None, passage)]
    rows += [(100, "z" * 500), (90, "z" * 60), (91, "z" * 49), (92, "z" * 50), (93, "y" + "z" * 51), (94, None), (95, ""), (96, "\0" * 70), (97, "\0" * 60 + "a"), (98, "\0" * 90)]
    assert found(docs_of(rows), groups=6, buckets=5) == brute(rows)


def test_long_texts_cross_chunks(docs_of, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 100)
    rows = corpus(9)
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for _, t in rows])
    cut = R.segments(data, ends, R.Rule())
    starts = [p for a, b in zip(cut.start, cut.end) for p in range(a, b - 49)]
    assert starts == [p for a, b in zip([0, *ends], ends) for p in range(a, b - 49)]  # each window once
    monkeypatch.undo()
    words = [f"word{i} " for i in range(900)]
    long = "".join(random.Random(3).choices(words, k=60_000))
    rows = [(1, long[200_000:230_000]), (2, long), (3, long[::-1])]
    assert found(docs_of(rows)) == brute(rows)


def test_segments_do_not_depend_on_the_order_of_texts(monkeypatch):
    """Each step reads the rows of a group anew, and a shuffle gives them in any order."""
    texts = [t.encode() for _, t in corpus(12)]

    def pieces(order):
        data, ends = np.frombuffer(b"".join(texts[i] for i in order), np.uint8), np.cumsum([len(texts[i]) for i in order])
        cut = R.segments(data, ends, R.Rule(), with_digest=True)
        text = np.searchsorted(ends, cut.start, "right")
        begin = np.concatenate(([0], ends))[text]
        return sorted(zip(np.array(order)[text].tolist(), (cut.start - begin).tolist(), (cut.end - begin).tolist(), cut.digest.tolist()))

    whole = pieces(list(range(len(texts))))
    monkeypatch.setattr(R, "CHUNK", 100)
    for seed in range(5):
        assert pieces(random.Random(seed).sample(range(len(texts)), len(texts))) == whole


def test_the_largest_doc_id_is_not_null(docs_of):
    rows = [(2**63 - 1, "t" * 60), (None, "u" * 60), (5, "t" * 55)]
    assert found(docs_of(rows)) == brute(rows)


def test_groups_are_maximal_and_complete():
    rng = random.Random(2)
    rule = R.Rule(6, 2)
    strings = list({"".join(rng.choices("ab", k=rng.randrange(6, 11))).encode() for _ in range(60)})
    sizes = np.array([len(s) for s in strings])
    rows = np.zeros((len(strings), 10), np.uint8)
    for i, s in enumerate(strings):
        rows[i, : len(s)] = np.frombuffer(s, np.uint8)
    doc = np.array([rng.randrange(20) for _ in strings])
    got = R.repeat_groups(rows, sizes, doc, doc, rule)
    covered = defaultdict(set)
    for s, a, e, first in zip(got.string, got.start, got.end, got.first):
        sub = strings[s][a:e]
        assert len(sub) >= 6 and first == min(doc[i] for i, t in enumerate(strings) if sub in t) < doc[s]
        covered[s] |= set(range(a, e))
    for i, s in enumerate(strings):
        want = {p for a in range(len(s) - 5) for p in range(a, a + 6) if any(s[a : a + 6] in t and doc[j] < doc[i] for j, t in enumerate(strings))}
        assert covered[i] == want


def test_edges(docs_of):
    assert R.remove_repeats(docs_of([])).count() == 0
    assert found(docs_of([(1, "a" * 60)])) == brute([(1, "a" * 60)])
    clash = docs_of([(1, "t" * 60, 3), (2, "t" * 60, 4)], "doc_id long, text string, g int")
    assert found(clash) == brute([(1, "t" * 60), (2, "t" * 60)])
    with pytest.raises(ValueError):
        R.Rule(10, 10)


def test_one_shuffle_of_the_texts(docs_of):
    plan = R.remove_repeats(docs_of(corpus(1)))
    plan.collect()
    assert str(plan._jdf.queryExecution().executedPlan()).count("ReusedExchange") >= 2
