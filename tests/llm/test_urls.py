import random

from pyspark.sql import functions as F

from gridloom.llm import urls as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([i for i in (path.find(c) for c in "?#") if i >= 0] + [len(path)])
    return host, path[:end]


def brute(rows):
    judged = []
    for page, url in rows:
        host, path = parts(url)
        fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, said = max(fits, default=(0, None, None))
        judged.append((page, host, path, rule, said))
    listed = {j[1] for j in judged if j[4] == "block"} - {j[1] for j in judged if j[4] == "allow"}
    return sorted(((p, h, q, r, s or ("block" if h in listed else "allow")) for p, h, q, r, s in judged), key=str)


def corpus(n=3000):
    rng = random.Random(1)
    odd = [None, "", "no scheme", "http://", "://x/y", "HTTP://ORG/a", "http://a.ORG?x=/b", "http://notorg/", "http://com/de/x", "http://É.com/fr/", "x://y://z/de/", "http://h.com\n/de/1", "http://u:p@b.com:80/de/#f"]
    rows = []
    for i in range(n):
        host = f"{rng.choice(['www', 'm', 'blog'])}.h{rng.randrange(n // 3)}.example.{rng.choice(['org', 'com', 'net'])}"
        rows.append((i, f"http://{host}/{rng.choice(['de', 'fr', 'es', 'en'])}/{rng.randrange(300)}{rng.choice(['', '?a=b', '#c', '/'])}"))
    return rows + [(n + i, u) for i, u in enumerate(odd)]


def test_query_against_brute_force(spark):
    rows = corpus()
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for limit in (U.MAX_WORDS, 60):  # one cascade, and one for each of several parts
        judged = U.judge_urls(pages, max_words=limit)
        assert sorted((tuple(r) for r in judged.drop("listed").collect()), key=str) == brute(rows)
        plan = judged._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and ("part" in plan) == (limit < U.MAX_WORDS)


def test_given_list(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.net/"), (3, None), (4, "http://com/fr/")], "page_id long, url string")
    given = spark.createDataFrame([("A.net",), ("A.net",), ("com",), ("absent.net",), (None,)], "host string")
    got = {r["page_id"]: (r["listed"], r["verdict"]) for r in U.judge_urls(pages, listed=given).collect()}
    assert got == {1: (True, "block"), 2: (False, "allow"), 3: (False, "allow"), 4: (True, "allow")}


def test_cascade_is_exact(spark):
    keys = [(f"key{i}", i % 3 == 0) for i in range(5000)] + [("", True), (None, False)]
    universe = spark.createDataFrame(keys, "key string, listed boolean")
    cascade = U.build_cascade(universe)
    assert len(cascade.levels) > 1 and list(cascade.sizes)[0] == sum(listed for _, listed in keys)
    wrong = universe.where(cascade.holds(F.col("key")) != F.col("listed"))
    assert wrong.count() == 0
    plan = universe.withColumn("is", cascade.holds(F.col("key")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    for side in (True, False):
        only = spark.createDataFrame([("a", side), ("b", side)], "key string, listed boolean")
        assert only.where(U.build_cascade(only).holds(F.col("key")) != side).count() == 0
    none = universe.limit(0)
    assert U.build_cascade(none).levels == ()


def test_edges(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    rows = [(None, None), (1, "http://a.com/de/"), (1, "http://a.com/de/"), (None, "http://a.com/en/"), (2, "http://b.org/" + "x" * 100_000)]
    got = U.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).drop("listed").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    clash = spark.createDataFrame([(1, "http://a.com/", "h", "r")], "page_id long, url string, host string, listed string")
    assert U.judge_urls(clash).count() == 1
