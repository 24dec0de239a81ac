import random
import time
import tracemalloc
import zlib

import numpy as np

from gridloom.llm import quality as Q
from gridloom.llm.queries import QUERIES

WORDS = "the of and in to report other small great water house people number first second through between always".split()


def good(rng):
    return "\n".join(" ".join(rng.choices(WORDS, k=rng.randint(4, 40))).capitalize() + "." for _ in range(rng.randint(1, 9)))


def bad(rng):
    kind = rng.randrange(3)
    lines = []
    for _ in range(rng.randint(1, 9)):
        words = rng.choices(WORDS, k=rng.randint(4, 40))
        lines.append(" ".join(w + "***" for w in words) if kind == 0 else "!! ".join(words).upper() if kind == 1 else " | ".join(words))
    edge = [good(rng).split("\n")[0]] if rng.random() < 0.5 else []
    return "\n".join(edge + lines + edge)


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    quality = [int(rng.random() < 0.7) for _ in range(n)]
    return [(i, good(rng) if q else bad(rng)) for i, q in enumerate(quality)], [(i, q, 0) for i, q in enumerate(quality)]


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    model = Q.LineCrf(rng.normal(size=5), rng.normal(size=(2, 2)))
    lines = np.array([3, 1, 4, 2])
    x = rng.normal(size=(lines.sum(), 5))
    good = x @ model.weights
    got, at = model.marginals(good, lines), 0
    pairs = iter(Q._expected_pairs(good, lines, model.moves)[1])
    for n in lines:
        score = x[at : at + n] @ model.weights
        total, ones, twos = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for path in range(1 << n):
            s = [path >> i & 1 for i in range(n)]
            p = np.exp(sum(score[i] for i in range(n) if s[i]) + sum(model.moves[a, b] for a, b in zip(s, s[1:])))
            total += p
            ones += p * np.array(s)
            for i, pair in enumerate(zip(s, s[1:])):
                twos[(i, *pair)] += p
        assert np.allclose(got[at : at + n], ones / total)
        assert all(np.allclose(next(pairs), twos[i] / total) for i in range(n - 1))
        at += n


def test_long_chains_by_a_plain_loop():
    rng = np.random.default_rng(4)
    lines = np.array([1, 5000, 64, 65, 300])
    good, moves = rng.normal(size=lines.sum()) * 3, rng.normal(size=(2, 2))
    got, at = Q.LineCrf(np.zeros(1), moves).marginals(good, lines), 0
    for n in lines:
        e = np.column_stack([np.zeros(n), good[at : at + n]])
        a, b = [e[0]], [np.zeros(2)]
        for t in range(1, n):
            a.append(np.array([np.logaddexp(a[-1][0] + moves[0, j], a[-1][1] + moves[1, j]) for j in (0, 1)]) + e[t])
            b.append(np.array([np.logaddexp(*(moves[i] + e[n - t] + b[-1])) for i in (0, 1)]))
        both = np.array(a) + np.array(b[::-1])
        assert np.allclose(got[at : at + n], 1 / (1 + np.exp(both[:, 0] - both[:, 1])))
        at += n


def test_transitions_are_learned():
    """Documents whose lines agree teach the field that lines stay as they are."""
    rows, labels = corpus(300, 5)
    model = Q.fit_crf([t.encode() for _, t in rows], np.array([float(q) for _, q, _ in labels]))
    assert model.moves[0, 0] + model.moves[1, 1] > model.moves[0, 1] + model.moves[1, 0] + 0.5


def test_a_text_of_three_million_lines():
    rng = random.Random(9)
    model = Q.LineCrf(np.random.default_rng(1).normal(size=3 * Q.N_OWN + 1), np.array([[0.3, -0.2], [-0.4, 0.5]]))
    text = ("\n" * 3_000_000).encode()
    some = "\n".join(" ".join(rng.choices(WORDS, k=rng.randint(0, 5))) for _ in range(3000)).encode()
    began, tracked = time.perf_counter(), tracemalloc.start()
    assert 0 <= model.score([text])[0] <= 1 and tracked is None
    assert tracemalloc.get_traced_memory()[1] < 600 << 20 and time.perf_counter() - began < 60
    tracemalloc.stop()
    x, sizes, lines = Q.line_features([some, b"", b"x\n"])
    scores = Q.line_scores([some, b"", b"x\n"], model.weights, 100)
    assert np.allclose(scores[0], x @ model.weights) and np.array_equal(scores[1], sizes) and np.array_equal(scores[2], lines)


def test_features_do_not_depend_on_the_batch():
    texts = [b"", b"One line.", b"A\n\nB | C\n", "é É ß***\n!!".encode(), b"\n\n"]
    x, sizes, lines = Q.line_features(texts)
    assert lines.tolist() == [1, 1, 4, 2, 3] and sizes.sum() == sum(len(t) - t.count(b"\n") for t in texts)
    at = 0
    for text, n in zip(texts, lines):
        assert np.array_equal(Q.line_features([text])[0], x[at : at + n])
        at += n
    own = x[:, : Q.N_OWN]
    assert np.array_equal(x[3, Q.N_OWN : 2 * Q.N_OWN], own[2]) and not x[2, Q.N_OWN : 2 * Q.N_OWN].any()
    assert np.array_equal(x[3, 2 * Q.N_OWN : 3 * Q.N_OWN], own[4])


def test_held_out_accuracy(spark, docs_of):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    model = Q.train(docs, table)
    got = {r["doc_id"]: r for r in Q.score_documents(docs, model).collect()}
    quality = {i: q for i, q, _ in labels}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    right = [got[i]["predicted"] == quality[i] for i in held]
    assert len(held) > 100 and np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    # labels that are held out change nothing
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = Q.train(docs, flipped)
    assert np.array_equal(model.weights, again.weights) and (model.scale, model.shift) == (again.scale, again.shift)


def test_bounded_sample(spark, docs_of):
    rows, labels = corpus(200, 2)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = Q.train(docs_of(rows), table, most=50)
    scores = [r["predicted"] for r in Q.score_documents(docs_of(rows), model).orderBy("doc_id").collect()]
    assert np.mean([s == q for s, (_, q, _) in zip(scores, labels)]) > 0.8


def test_edges(spark, docs_of):
    labels = "doc_id long, quality int, toxic int"
    docs = docs_of([(None, None), (1, ""), (1, "x"), (2, "\n\n"), (3, "word " * 200_000), (4, "é" * 10_000)])
    for table in ([], [(1, 1, 0)], [(1, None, 0), (None, 1, 0), (2, 0, 0), (2, 1, 0), (3, 0, 0), (4, 1, None)]):
        model = Q.train(docs, spark.createDataFrame(table, labels))
        got = Q.score_documents(docs, model).collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert Q.score_documents(docs_of([]), model).count() == 0
    kept = Q.good_documents(docs, Q.LineCrf(model.weights * 0, model.moves * 0, 0.0, 5.0, 0.9))
    assert kept.count() == 6 and kept.columns == docs.columns
    clash = docs_of([(1, "t", 0.5)], "doc_id long, text string, score double")
    assert Q.good_documents(clash, Q.LineCrf(model.weights * 0, model.moves * 0, 0.0, 5.0, 0.9)).columns == ["doc_id", "text", "score"]


def test_query_is_the_model_on_each_text(spark, docs_of, tmp_path):
    rows, labels = corpus(150, 3)
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    table.write.parquet(str(tmp_path / "labels.parquet"))
    model = Q.train(docs_of(rows), table)
    got = {r["doc_id"]: r["score"] for r in QUERIES["op9_line_crf_quality"](spark, str(tmp_path)).collect()}
    for i, text in rows:
        assert abs(got[i] - model.score([text.encode()])[0]) < 1e-9
