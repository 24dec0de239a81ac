import random
import zlib
from collections import defaultdict
from unicodedata import category

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.tokenizer_file())


TRICKY = ["", " ", "it's <|endoftext|> ok", "x\x01y \x1c\x85z", "Σας ΣΑΣ don't", "　漢字 123", "İstanbul ǅ ß STRASSE ﬁ école É", "'S It'S x,y z.,!' a1b2 Ⅷ ª"]


def test_words_give_the_ids_of_the_text(tokenizer):
    rng = random.Random(1)
    parts = ["the", "Café", "x***", "12,5", "end.", "(a)", "don't", "naïve", "\n", "ЖУК", "a-b", "…", "ﬁ!"]
    texts = TRICKY + [" ".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(300)]
    for remembered in (10, 100_000):
        encoder = P.WordEncoder(P.tokenizer_file(), remembered)
        for text in texts:
            assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            assert len(encoder.words) <= remembered + 8


def test_words_of_all_categories():
    """20,000 strings of characters of every category, punctuation and letters that change in lower case."""
    encoder, rng, by = P.WordEncoder(P.tokenizer_file()), random.Random(4), defaultdict(list)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        by[category(c)].append(c)
    kinds = sorted(by)
    for _ in range(20_000):
        some = [rng.choice((P.TRAILING + " \n", "abXYZ09İıßéÑǅﬁΣςｘ", by[rng.choice(kinds)])[rng.randrange(3)]) for _ in range(rng.randint(1, 14))]
        assert encoder.encode("".join(some)) == encoder.words.whole("".join(some)), some
    for text in ("İ.", "TARİHİ. son", "a\u0307.", "École. ÉCOLE!"):
        assert encoder.encode(text) == encoder.words.whole(text)


def test_assignment():
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(200)]
    n = sum(lengths) // 100
    bins, cost, over = P.assign(lengths, [100] * n, 1.0, 0.01)
    assert all(sum(k for _, _, k in b) == 100 for b in bins) and sum(k for _, _, k in over) == sum(lengths) - 100 * n
    covered = defaultdict(list)
    for piece in [p for b in bins for p in b] + over:
        covered[piece[0]].append(piece[1:])
    for doc, pieces in covered.items():
        at = 0
        for start, k in sorted(pieces):
            assert start == at
            at += k
        assert at == lengths[doc]
    assert cost.max() / cost.min() < 1.6
    assert P.powers_of_two(13) == [8, 4, 1] and P.powers_of_two(0) == []


def check(rows, got, tokenizer, length):
    expected = sorted((i is None, i or 0, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and 0 < r["length"] <= length
        pieces[r["doc_id"]].append((r["doc_tokens"], r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length and at & (at - 1) == 0  # every sequence is full, or needs no padding
    ids_of = sorted((k is None, k or 0, sum((ids for _, _, ids in sorted(v)), [])) for k, v in pieces.items() if len({i for i, _ in rows}) == len(rows))
    if ids_of:
        assert ids_of == expected
    assert sum(r["length"] for r in got) == sum(len(ids) for *_, ids in expected)


def test_query_against_brute_force(docs_of, tokenizer):
    rng = random.Random(5)
    words = [f"tok{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 50, 300, 3000])))) for i in range(120)] + [(998, None), (999, ""), (None, "no id")]
    for parts in (1, 5):
        got = P.pack_documents(docs_of(rows).repartition(parts), window=1 << 14).collect()
        check(rows, got, tokenizer, 4096)
    checked = P.pack_documents(docs_of(rows)).select("ids", F.crc32("ids").alias("c")).collect()
    assert all(zlib.crc32(r["ids"]) == r["c"] for r in checked)


def test_edges(docs_of, tokenizer):
    assert P.pack_documents(docs_of([])).count() == 0
    (one,) = P.pack_documents(docs_of([(7, None)])).collect()
    assert (one["doc_id"], one["length"], one["doc_tokens"], one["offset"]) == (7, 1, 1, 0)
    rows = [(1, "same words"), (1, "same words"), (2, "word " * 20_000)]
    check(rows, P.pack_documents(docs_of(rows)).collect(), tokenizer, 4096)
    assert P.pack_documents(docs_of([(1, "t", 3)], "doc_id long, text string, offset long")).count() == 1
