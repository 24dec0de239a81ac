import random

import corpus_pipeline as C
from gridloom.llm import quality

from .test_mixing import brute as brute_mix
from .test_packing import check
from .test_pii import PATTERNS, passes
from .test_quality import bad, good
from .test_simhash import brute as components
from .test_simhash import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, path, n=150):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        fine = rng.random() < 0.75
        text = good(rng) if fine else bad(rng)
        if fine and i % 6 == 0:
            text += f"\nWrite to user{i}@mail.example.com or call +1 (415) 555-26{i % 90 + 10}."
        rows.append((i, text, "en", f"src{rng.choice([0, 0, 1, 2, 3])}", len(text)))
        labels.append((i, int(fine), 0))
    rows += [(1000 + i, rows[3][1], "en", "src1", None) for i in range(20)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "src0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def redacted(text):
    import re

    found = sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if passes(k, m[0]))
    out, at = "", 0
    for s, k, e in found:
        if s >= at:
            out += text[at:s] + ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")[k]
        at = max(at, e)
    return text if text is None else out + text[at:]


def test_stages_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    from gridloom.llm.packing import tokenizer_file

    sf = str(tmp_path)
    docs = tables(spark, sf)
    stages = dict(C.STAGES)
    assert [name for name, _ in C.STAGES] == ["quality classifier", "SimHash near-dedup", "PII", "mixing sources to target weights", "packing"]

    kept = stages["quality classifier"](spark, docs, sf)
    assert kept.columns == COLUMNS
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    expected = {i for i, r in rows.items() if model.score([(r["text"] or "").encode()])[0] >= 0.5}
    assert {r["doc_id"] for r in kept.collect()} == expected and len(expected) < len(rows)

    alone = stages["SimHash near-dedup"](spark, kept, sf)
    assert alone.columns == COLUMNS
    ids = sorted(expected)
    least = components([plain(rows[i]["text"]) for i in ids])
    expected = {ids[k] for k in least}
    assert {r["doc_id"] for r in alone.collect()} == expected and len(expected) < len(ids)

    clean = stages["PII"](spark, alone, sf)
    assert clean.columns == COLUMNS
    texts = {i: redacted(rows[i]["text"]) for i in expected}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()} == {i: (t, len(t or "")) for i, t in texts.items()}
    assert any("[EMAIL]" in (t or "") for t in texts.values())

    mixed = stages["mixing sources to target weights"](spark, clean, sf)
    assert mixed.columns == COLUMNS
    shares = brute_mix([(i, t, None, rows[i]["source"]) for i, t in texts.items()])
    counts = {}
    for r in mixed.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert {i: c for i, c in counts.items() if texts[i]} == {i: taken // size for i, size, _, _, taken in shares if taken}

    pieces = stages["packing"](spark, mixed, sf).collect()
    repeated = [(i, texts[i]) for i, c in counts.items() for _ in range(c)]
    check(repeated, pieces, Tokenizer.from_file(tokenizer_file()), 4096)

    whole = C.run(spark, sf).collect()
    assert sum(r["length"] for r in whole) == sum(r["length"] for r in pieces)
    assert sorted((r["doc_id"], r["start"]) for r in whole if r["start"] == 0) == sorted((r["doc_id"], r["start"]) for r in pieces if r["start"] == 0)
