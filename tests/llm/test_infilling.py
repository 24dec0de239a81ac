import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import infilling as I

ALPHABET = ["a", "Z", "é", "漢", "\U0001f600", " ", "\n", "<", "P", ">", "0", "\x00", "S", "M"]


def brute(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def strings(n):
    rng = random.Random(5)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(40))) for _ in range(n)]


def test_runs_count_units_and_find_every_cut(monkeypatch):
    for block in (3, I.BLOCK):
        monkeypatch.setattr(I, "BLOCK", block)
        for text in ["", "abc", "..", *strings(60)]:
            tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
            runs = I.Runs.of(text)
            assert runs.n == len(tokens)
            assert all(a != b for a, b in zip(runs.letters, runs.letters[1:]))  # runs are maximal
            assert [runs.offset(k) for k in range(len(tokens) + 1)] == [len("".join(tokens[:k])) for k in range(len(tokens) + 1)]


def test_operator_against_plain_python(docs_of):
    rows = list(enumerate(strings(300))) + [(None, "some words"), (7, "ab cd"), (7, "ab cd"), (-3, None), (9**17, ""), (400, "x" * 3_000_000 + "é" * 9)]
    made = I.fill_in_middle(docs_of(rows).repartition(3))
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(str(brute(*r)) for r in rows)
    back = I.restore_texts(made).select("doc_id", "restored").collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str((d, t or "")) for d, t in rows)
    for row in made.collect():
        assert I.restored(row["form"], row["output"]) in {t or "" for _, t in rows}


def test_markers_at_borders():
    for form in ("psm", "spm"):
        for p, m, s in [("<", "P>x", "<S"), ("<S", "<", "<M"), ("", "", ""), ("a<P", "<M", "<")]:
            assert I.restored(form, I.joined(form, p, m, s)) == p + m + s
    with pytest.raises(ValueError):
        I.restored("psm", "no marker")


def test_edges(docs_of):
    assert I.fill_in_middle(docs_of([])).count() == 0
    clash = docs_of([(1, "a b", "x", 5)], "doc_id long, text string, form string, n long")
    (row,) = I.fill_in_middle(clash).collect()
    assert tuple(row) == brute(1, "a b")
    long = I.fill_in_middle(docs_of([(i, "word " * 9000) for i in range(30)])).select(F.sum("n")).first()[0]
    assert long == 30 * 18000
