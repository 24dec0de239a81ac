"""URL verdicts: prefix rules first, then exact membership in a list by a cascade of Bloom filters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ascii_lower, materialise, scratch_path

#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A cascade's filters travel with the tasks; keys are dealt by hash to as many cascades as keep each to about so many 64-bit words (8 MB).
MAX_WORDS = 1 << 20


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no '://'."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule (host and prefix) and verdict of the longest rule that fits; nulls if none does.

    A rule fits its host and the host's subdomains, if the path starts with its prefix.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, at, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(prefix))
        rule, verdict = F.when(fits, F.lit(at + prefix)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class Filter:
    """One Bloom filter: a one-row table with its words, and how keys are hashed into it."""

    words: DataFrame
    n_words: int
    hashes: int
    salt: int

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.salt), F.lit(i)), F.lit(64 * self.n_words)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = self.words.scalar()
        found = F.lit(True)
        for at in self.positions(key):
            bit = F.call_function("bit_get", F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int"))
            found = found & (bit == 1)
        return found


def bloom_filter(keys: DataFrame, count: int, bits_per_key: int, hashes: int, salt: int) -> Filter:
    """Encode the column `key` of `count` rows: positions are combined word by word with bit_or."""
    n_words = max(1, -(-count * bits_per_key // 64))
    shape = Filter(keys, n_words, hashes, salt)
    set_bits = keys.select(F.explode(F.array(*shape.positions(F.col("key")))).alias("at"))
    words = set_bits.groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("word"))
    every = keys.sparkSession.range(n_words).join(words, "id", "left").select(F.struct("id", F.coalesce("word", F.lit(0)).alias("word")).alias("w"))
    dense = every.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["word"]).alias("words"))
    return Filter(materialise(dense, "bloom"), n_words, hashes, salt)


@dataclass(frozen=True)
class Cascade:
    """Filters whose levels alternate between listed keys and false positives; exact on its universe."""

    levels: tuple[Filter, ...]
    sizes: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 0)
        for k in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[k].holds(key), answer if k + 1 < len(self.levels) else F.lit(k % 2 == 0)).otherwise(F.lit(k % 2 == 1))
        return answer if self.levels else F.lit(False)


def build_cascade(universe: DataFrame) -> Cascade:
    """A cascade for (key, listed), which must hold every key that will ever be asked, once.

    Level 1 encodes the listed keys; level 2 the other keys that pass level 1; level 3 the
    listed keys that pass level 2; and so on until none passes. Null keys count as a key.
    """
    sides = [universe.where("listed").select("key"), universe.where("not listed").select("key")]
    levels: list[Filter] = []
    sizes: list[int] = []
    while True:
        keys = sides[len(levels) % 2]
        count = keys.count()
        if not count:
            return Cascade(tuple(levels), tuple(sizes))
        bits, hashes = (10, 7) if not levels else (6, 4)
        made = bloom_filter(keys, count, bits, hashes, len(levels))
        levels.append(made)
        sizes.append(count)
        other = len(levels) % 2
        sides[other] = materialise(sides[other].where(made.holds(F.col("key"))), "cascade-keys")


def _dealt(df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """df written in `parts` folders by the hash of a key, so that reading one part reads no other."""
    path = scratch_path(df.sparkSession, name)
    df = df.withColumn("part", F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts)).cast("int"))
    df.write.partitionBy("part").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def judge_urls(pages: DataFrame, rules=RULES, max_words: int = MAX_WORDS, listed: DataFrame | None = None) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict, listed.

    The longest fitting rule gives the verdict. Where none fits, a host that is listed is
    blocked and any other allowed. Listed are the hosts in the column host of `listed`;
    without it, those of which the rules block some URL and allow none. The corpus's hosts
    are the complete key universe, so the cascade of Bloom filters, which travels with the
    tasks, answers exactly and without a join. Where its filters would take more than about
    `max_words` words, hosts and rows are dealt by hash to several parts, written once, and
    each part has a cascade of its own.

    Null URLs and those without '://' have empty host and path; page_id may be null or
    repeat, each row is judged on its own. Other columns are not read. No row, no result.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = match_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said})
    if listed is None:
        is_listed = (F.count_if(F.col("said") == "block") > 0) & (F.count_if(F.col("said") == "allow") == 0)
        universe = rows.groupBy(F.col("host").alias("key")).agg(is_listed.alias("listed"))
    else:
        keys = rows.select("host", F.lit(True).alias("seen"), F.lit(False).alias("listed"))
        keys = keys.unionByName(listed.select(ascii_lower(F.col("host")).alias("host"), F.lit(False).alias("seen"), F.lit(True).alias("listed")))
        universe = keys.groupBy(F.col("host").alias("key")).agg(F.max("seen").alias("seen"), F.max("listed").alias("listed")).where("seen").drop("seen")
    universe = materialise(universe, "url-hosts")
    yes, every = universe.agg(F.count_if("listed"), F.count(F.lit(1))).first()
    parts = max(1, -(-int(12 * yes + 0.1 * (every - yes)) // (64 * max_words)))  # bits of the first level, and of those behind it
    if parts == 1:
        found = rows.withColumn("listed", build_cascade(universe).holds(F.col("host")))
    else:
        universe, rows = _dealt(universe, "key", parts, "url-keys"), _dealt(rows, "host", parts, "url-rows")
        at = F.col("part")
        judged = [rows.where(at == p).withColumn("listed", build_cascade(universe.where(at == p).drop("part")).holds(F.col("host"))) for p in range(parts)]
        found = reduce(DataFrame.unionByName, judged)
    verdict = F.coalesce("said", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


ORACLE = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(said, site, prefix) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT DISTINCT host, path FROM p),
m AS (SELECT u.host, u.path, arg_max(site || prefix, length(site || prefix)) AS rule, arg_max(said, length(site || prefix)) AS said
      FROM u JOIN r ON (u.host = site OR ends_with(u.host, '.' || site)) AND starts_with(u.path, prefix) GROUP BY ALL),
x AS (SELECT p.page_id, p.host, p.path, m.rule, m.said FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path),
l AS (SELECT host, count(*) FILTER (WHERE said = 'block') > 0 AND count(*) FILTER (WHERE said = 'allow') = 0 AS listed FROM x GROUP BY host)
SELECT page_id, x.host, path, rule, coalesce(said, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM x JOIN l ON x.host = l.host
"""
