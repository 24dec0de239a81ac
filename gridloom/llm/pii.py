"""Personal data: base patterns, high-recall candidates scored by boosted trees, and redaction. No Python on executors.

Every step takes time in proportion to the text and to n log n for its n spans: starts are sums of lengths by
doubling, spans are looked up by bisection, and slices are cut from blocks of the text.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import lru_cache
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees, calibrated_threshold, fit_trees
from .pii_samples import generated

# The four base patterns. Possessive quantifiers and look-behinds change no
# match; they keep Java's matcher linear and flat on long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Kinds in the order in which spans that start together are listed.
BASE = ("email", "ip", "card", "phone")
# Candidates beyond the base patterns, with generous shapes that overlap; the trees decide.
# "secret" and "key" are runs with and without joining characters, "password" is what a naming
# word and a sign stand before.
CANDIDATES = {
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}+",
    "key": r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+",
    "password": r"(?i)(?:pass|pwd|secret|token|key|auth|credential|contrase|mot\x20de)[\p{L}_-]{0,12}+[\x22\x27]?\x20{0,2}[:=]\x20{0,2}[\x22\x27]?[^\x20\x09-\x0D\x22\x27,;<>]{4,}+",
    "pem": r"-----BEGIN\x20[A-Z0-9\x20]{1,40}+-----[A-Za-z0-9+/=\x20\x09-\x0D]*+-----END\x20[A-Z0-9\x20]{1,40}+-----",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{2,}+(?:\.[A-Za-z0-9_-]++)?",
    "ssn": r"(?<![0-9-])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "local": r"(?<![0-9.+-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
}
#: What a text must hold for a candidate of the kind.
NEEDS = {"password": "rlike({}, '[:=]')", "pem": "contains({}, '-----BEGIN')", "jwt": "contains({}, 'eyJ')", **dict.fromkeys(("ssn", "iban", "local"), "rlike({}, '[0-9]')")}
#: The part of a password's match before the span.
NAMING = r"(?s)^[^:=]*+[:=]\x20{0,2}[\x22\x27]?"
KINDS = (*BASE, *CANDIDATES)
#: Characters before a candidate that its features look at.
CONTEXT = 40
#: Code points in a block of a text.
BLOCK = 512

SPANS = "array<struct<s:int,k:int,e:int,m:string>>"


_NONE = f"cast(array() as {SPANS})"
_names = count()


def _lambda(body: Callable[..., str], arguments: int = 1) -> str:
    """A lambda function in SQL; its variables have names of their own."""
    names = [f"v{next(_names)}" for _ in range(arguments)]
    return f"{names[0] if arguments == 1 else f'({", ".join(names)})'} -> {body(*names)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """body(value) with the value computed once, also where body uses it for each element of an array."""
    return f"get(transform(array({value}), {_lambda(body)}), 0)"


def _over(function: str, values: str, body: Callable[..., str], arguments: int = 1) -> str:
    return f"{function}({values}, {_lambda(body, arguments)})"


def _fold(values: str, start: str, step: Callable[[str, str], str]) -> str:
    return f"aggregate({values}, {start}, {_lambda(step, 2)})"


def _like(text: str, pattern: str) -> str:
    return f"rlike({text}, r'{pattern}')"


def _without(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, r'{pattern}', '')"


def _running(values: str, combine: Callable[[str, str], str]) -> str:
    """values[0] .. values[i] combined, for each i, by doubling: about log2(n) passes over the array."""
    passes = f"if(size({values}) > 1, sequence(0, cast(ceil(log2(size({values}))) as int) - 1), cast(array() as array<int>))"

    def step(acc: str, j: str) -> str:
        joined = lambda back: _over("transform", acc, lambda x, i: f"if({i} >= {back}, {combine(x, f'get({acc}, {i} - {back})')}, {x})", 2)
        return let(f"cast(pow(2, {j}) as int)", joined)

    return _fold(passes, values, step)


def _starts_by(spans: str, at: str) -> str:
    """How many of the spans, sorted by start, start no later than `at`, by bisection."""

    def step(found: str, j: str) -> str:
        return let(f"{found} + cast(pow(2, {j}) as int)", lambda n: f"if({n} <= size({spans}) and get({spans}, {n} - 1).s <= {at}, {n}, {found})")

    return _fold(f"sequence(cast(ceil(log2(size({spans}) + 1)) as int), 0, -1)", "0", step)


def blocks_of(text: str) -> str:
    return f"regexp_extract_all({text}, r'(?s).{{1,{BLOCK}}}', 0)"


def slice_of(blocks: str, start: str, end: str) -> str:
    """Code points start to end of a text in blocks; the cost does not depend on where they stand."""

    def cut(s: str, e: str, first: str, last: str) -> str:
        head = f"substring(get({blocks}, {first}), {s} % {BLOCK} + 1"
        across = f"concat({head}, {BLOCK}), array_join(slice({blocks}, {first} + 2, {last} - {first} - 1), ''), substring(get({blocks}, {last}), 1, {e} - {last} * {BLOCK}))"
        return f"if({first} = {last}, {head}, {e} - {s}), {across})"

    inside = let(f"struct({start} as s, {end} as e)", lambda x: f"if({x}.e <= {x}.s, '', {cut(f'{x}.s', f'{x}.e', f'int({x}.s div {BLOCK})', f'int(({x}.e - 1) div {BLOCK})')})")
    return inside


def spans_of(text: str, pattern: str, kind: int, skip: str | None = None) -> str:
    """All matches, leftmost first and not overlapping, as structs: start, kind, end (code points), match.

    split() gives what lies between the matches of regexp_extract_all(), so ends are running
    sums of lengths. Both walk the text with the same matcher. What `skip` matches at the
    start of a match is not part of its span.
    """

    def span(m: str, end: str) -> str:
        named = lambda v: f"struct({end} - length({v}) as s, {kind} as k, {end} as e, {v} as m)"
        return let(_without(m, skip) if skip else m, named)

    def built(found: str) -> str:
        between = f"slice(split({text}, r'{pattern}', -1), 1, size({found}))"
        steps = f"zip_with({found}, {between}, {_lambda(lambda m, b: f'length({m}) + length({b})', 2)})"
        ended = lambda ends: _over("transform", found, lambda m, i: let(f"get({ends}, {i})", lambda end: span(m, end)), 2)
        return let(steps, lambda lengths: let(_running(lengths, lambda x, y: f"{x} + {y}"), ended))

    return let(f"regexp_extract_all({text}, r'{pattern}', 0)", lambda found: f"if(size({found}) > 0, {built(found)}, {_NONE})")


def digits(match: str) -> str:
    return _without(match, "[^0-9]")


def luhn(number: str) -> str:
    """True if a string of digits passes the Luhn check."""
    figures = _over("filter", f"split(reverse({number}), '')", lambda d: f"{d} != ''")
    step = lambda acc, d: let(f"int({d}) * ({acc}.i % 2 + 1)", lambda v: f"struct({acc}.sum + {v} - if({v} > 9, 9, 0) as sum, {acc}.i + 1 as i)")
    return f"{_fold(figures, 'struct(0 as sum, 0 as i)', step)}.sum % 10 = 0"


def octets(match: str) -> str:
    """True if each part between dots is 255 at most, leading zeros aside."""
    fits = lambda part: let(_without(part, "^0+"), lambda bare: f"length({bare}) < 3 or (length({bare}) = 3 and {bare} <= '255')")
    return _over("forall", rf"split({match}, r'\.')", fits)


def base_spans(text: str) -> str:
    """The base spans by the contract's patterns and checks, sorted by start, then kind."""
    if_holds = lambda part, found: f"if(contains({text}, '{part}'), {found}, {_NONE})"
    ip = _over("filter", spans_of(text, IP, 1), lambda x: octets(f"{x}.m"))
    valid = lambda d: f"if(length({d}) between 12 and 19, {luhn(d)}, false)"
    card = _over("filter", spans_of(text, CARD, 2), lambda x: let(digits(f"{x}.m"), valid))
    phone = _over("filter", spans_of(text, PHONE, 3), lambda x: f"length({digits(f'{x}.m')}) between 9 and 15")
    numbers = f"if({_like(text, '[0-9]')}, concat({ip}, {card}), {_NONE})"
    return f"array_sort(concat({if_holds('@', spans_of(text, EMAIL, 0))}, {numbers}, {if_holds('+', phone)}))"


def _outside(base: str, found: str) -> str:
    """The candidates that do not lie wholly inside one of `base`, which are sorted: of those that start no later, the furthest end tells."""
    free = lambda reach, x: let(_starts_by(base, f"{x}.s"), lambda n: f"{n} = 0 or get({reach}, {n} - 1) < {x}.e")
    picked = lambda reach: _over("filter", found, lambda x: free(reach, x))
    ends = _over("transform", base, lambda b: f"{b}.e")
    reached = let(ends, lambda e: let(_running(e, lambda x, y: f"greatest({x}, {y})"), picked))
    return f"if(size({base}) = 0 or size({found}) = 0, {found}, {reached})"


def candidate_spans(text: str) -> str:
    """Proposals of every generator; those of one kind do not overlap, those of different kinds may.

    A block between BEGIN and END is judged as a whole, so what lies inside it is no proposal.
    """

    def proposed(kind: str) -> str:
        found = spans_of(text, CANDIDATES[kind], KINDS.index(kind), NAMING if kind == "password" else None)
        return f"if({NEEDS[kind].format(text)}, {found}, {_NONE})" if kind in NEEDS else found

    others = f"concat({', '.join(proposed(kind) for kind in CANDIDATES if kind != 'pem')})"
    return let(proposed("pem"), lambda pem: f"concat({pem}, {let(others, lambda found: _outside(pem, found))})")


def _remainder(m: str) -> str:
    """An account number's remainder by 97, with its first four characters last and letters as 10 to 35; 1 if it is valid."""
    turned = let(f"replace({m}, ' ', '')", lambda bare: f"split(concat(substring({bare}, 5), substring({bare}, 1, 4)), '')")
    value = lambda c: f"if({c} between '0' and '9', ascii({c}) - 48, ascii({c}) - 55)"
    step = lambda acc, c: let(value(c), lambda v: f"({acc} * if({v} > 9, 100, 10) + {v}) % 97")
    return _fold(_over("filter", turned, lambda c: f"{c} != ''"), "0", step)


def features(m: str, k: str, c: str) -> dict[str, str]:
    """Format and context of a candidate: `m` is its text, `k` its kind, `c` what stands before it in small letters."""
    left = lambda pattern: f"length({_without(m, pattern)}) / length({m})"
    like = lambda pattern: f"double({_like(m, pattern)})"
    seen = lambda pattern: f"double({_like(c, pattern)})"
    of = lambda kind, value: f"if({k} = {KINDS.index(kind)}, {value}, 0D)"
    classes = m
    for chars, name in (("0-9", "0"), ("A-Z", "A"), ("a-z", "a")):
        classes = f"regexp_replace({classes}, '[{chars}]+', '{name}')"
    return {
        "length": f"double(least(length({m}), 1000))",
        "digits": left("[^0-9]"),
        "capitals": left("[^A-Z]"),
        "hex": left("[^0-9a-f]"),
        "upper_hex": left("[^0-9A-F]"),
        "vowels": left("[^aeiouyAEIOUY]"),
        "changes": f"length({classes}) / length({m})",
        "separators": left("[A-Za-z0-9]"),
        "spaces": left("[^ ]"),
        "words": left(r"(?<![A-Za-z])[A-Za-z]?[a-z]{1,11}+(?![A-Za-z])"),
        "repeats": left(r"(.)(?=\1)"),
        "kind": f"double({k})",
        "issued": like(r"^/?(?:AKIA|ASIA|AIza|gh[opsur]_|glpat|xox[a-z]-|npm_|eyJ|MII|AAAA|SK|(?:sk|pk|rk)[_-])"),
        "private": of("pem", like("(?i)private|secret")),
        "valid": f"{of('ssn', like('^(?!000|666|9)...[ -](?!00)..[ -](?!0000)'))} + {of('iban', f'double({_remainder(m)} = 1)')}",
        "three_three_four": like(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"),
        "bracketed": like(r"^\([0-9]+\)"),
        "placeholder": like(r"(?i)^(?:[\[{(*x.]+|none|null|true|false|n/?a|example|changeme|required|optional|empty|missing|hidden|redacted|unknown)"),
        "password_word": seen(r"(^|[^a-z])(password|passwort|passwd|passphrase|passcode|pass|pwd|contrase.{1,2}a|mot de passe)[\x22\x27]?\s*[:=]\s*[\x22\x27]?$"),
        "assigned": seen(r"[=:]\s*[\x22\x27]?$"),
        "secret_word": seen(r"(token|key|secret|pass|pwd|bearer|auth|credential|private|signature|ssh-rsa)[^\n]{0,12}$"),
        "person_word": seen(r"(ssn|social|security|iban|account|bank|konto|cuenta|compte)[^\n]{0,16}$"),
        "phone_word": seen(r"(phone|tel|call|fax|mobile|cell|contact|whatsapp|handy)[^\n]{0,12}$"),
        "hash_word": seen(r"(commit|sha-?[0-9]*|md5|checksum|digest|hash|etag|revision|rev|uuid|build|blob|tree)[^\n]{0,10}$"),
        "number_word": seen(r"(order|invoice|page|pages|section|part|serial|item|isbn|ref|range|years?|nr|no|number|ticket|version)[^\na-z]{0,6}$"),
        "in_address": seen(r"https?://\S*$"),
        "in_path": seen(r"[a-z0-9][/.]$"),
        "after_number": seen(r"[0-9][^a-z]{0,3}$"),
    }


def _named(values: dict[str, str]) -> str:
    return f"struct({', '.join(f'{v} as {n}' for n, v in values.items())})"


def described_samples(spark: SparkSession, samples: list[tuple[str, int, str, float]], at_once: int = 500) -> DataFrame:
    """Label, kind and features of (candidate, kind, text before it, label); the rows go to Spark as JSON texts."""
    parts = [json.dumps([dict(zip("mkcy", s)) for s in samples[i : i + at_once]]) for i in range(0, len(samples), at_once)]
    rows = spark.createDataFrame([(p,) for p in parts], "part string")
    rows = rows.selectExpr("inline(from_json(part, 'array<struct<m:string,k:int,c:string,y:double>>'))")
    return rows.selectExpr("y", "k", "lower(c) as c", "m").selectExpr("y", "k", *features("m", "k", "c").values())


@lru_cache(maxsize=4)
def _trained(samples: int, seed: int, precision: float) -> tuple[BoostedTrees, dict[int, float]]:
    """The trees, and a threshold on the logit for each kind."""
    spark = SparkSession.active()

    def table(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        described = described_samples(spark, generated(samples, seed, context=CONTEXT))
        got = np.array(described.collect(), float)
        return got[:, 2:], got[:, 0], got[:, 1]

    x, y, _ = table(seed)
    held_x, held_y, kind = table(seed + 1)
    model = fit_trees(x, y)
    logit = model.logit(held_x)
    return model, {k: calibrated_threshold(logit[kind == k], held_y[kind == k], precision) for k in range(len(BASE), len(KINDS))}


def scored(text: str, found: str, samples: int = 6000, seed: int = 5, precision: float = 0.98) -> str:
    """The candidates whose margin (boosted logit less the threshold of their kind) is not negative, with it as `p`.

    The trees are fitted on `samples` generated candidates, and a kind's threshold is the
    lowest with that precision on as many others; the corpus takes no part in it.
    """
    model, cuts = _trained(samples, seed, precision)
    threshold = f"array({', '.join(f'double({cuts.get(k, 0.0)!r})' for k in range(len(KINDS)))})".replace("double(inf)", "double('inf')")
    names = list(features("", "", ""))

    def judged(x: str, blocks: str) -> str:
        before = f"lower({slice_of(blocks, f'greatest({x}.s - {CONTEXT}, 0)', f'{x}.s')})"
        described = let(before, lambda c: _named(features(f"{x}.m", f"{x}.k", c)))
        margin = let(described, lambda f: model.logit_sql([f"{f}.{n}" for n in names]))
        return f"struct({x}.s as s, {x}.k as k, {x}.e as e, {x}.m as m, {margin} - get({threshold}, {x}.k) as p)"

    return let(blocks_of(text), lambda blocks: _over("filter", _over("transform", found, lambda x: judged(x, blocks)), lambda x: f"{x}.p >= 0"))


def _selected(kept: str) -> str:
    """Of overlapping candidates, leave out one that lies inside a wider one of no lesser margin; of those of one extent, the kind listed first stays."""
    of_kind = lambda k: _over("filter", kept, lambda x: f"{x}.k = {k}")
    by_kind = f"array({', '.join(of_kind(k) for k in range(len(BASE), len(KINDS)))})"

    def outdone(x: str, y: str) -> str:
        same = f"{y}.s = {x}.s and {y}.e = {x}.e"
        return f"coalesce({y}.k != {x}.k and {y}.e >= {x}.e and if({same}, {y}.k < {x}.k, {y}.p >= {x}.p), false)"

    def stands(x: str, others: str) -> str:
        beaten = lambda other: let(f"get({other}, {_starts_by(other, f'{x}.s')} - 1)", lambda y: outdone(x, y))
        return f"not {_over('exists', others, beaten)}"

    return f"if(size({kept}) < 2, {kept}, {let(by_kind, lambda others: _over('filter', kept, lambda x: stands(x, others)))})"


def _with_spans(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with the base spans and all spans of `text`, and the names of these two columns, which docs has not.

    A step's result is a column, as the analyser resolves some dozens of nested functions at
    most; the next step binds it once, so that it is never computed for each element.
    """
    own = uuid.uuid4().hex
    base, proposed, found, judged, spans = (f"{name}_{own}" for name in ("base", "proposed", "found", "judged", "spans"))
    plain = lambda kept: _over("transform", _selected(kept), lambda x: f"struct({x}.s as s, {x}.k as k, {x}.e as e, {x}.m as m)")
    steps = {
        base: base_spans(_TEXT),
        proposed: candidate_spans(_TEXT),
        found: let(base, lambda b: let(proposed, lambda f: _outside(b, f))),
        judged: let(found, lambda f: f"if(size({f}) > 0, {scored(_TEXT, f)}, null)"),
        spans: f"array_sort(concat({base}, {let(judged, lambda j: f'if(size({j}) > 0, {plain(j)}, {_NONE})')}))",
    }
    for name, sql in steps.items():
        docs = docs.withColumn(name, F.expr(sql))
    return docs.drop(proposed, found, judged), base, spans


_TEXT = "coalesce(`text`, '')"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Add `base` and `spans` to documents with `text`: arrays of structs (s, k, e, m).

    `base` holds the base spans, `spans` also the candidates that the trees keep, so spans may
    overlap. Left out are candidates that lie wholly inside a base span, or inside a wider
    candidate whose margin over its kind's threshold is no lesser; of candidates with one
    extent the kind listed first stays. Both arrays are sorted by
    start, then kind (an index into KINDS). Positions count code points from 0, ends are
    exclusive, `m` is the text in the span. Null and empty texts have none. Every row is on
    its own: other columns, nulls and repeats in them do not matter. Columns named base or
    spans are replaced.
    """
    docs, base, spans = _with_spans(docs.drop("base", "spans"))
    return docs.withColumnsRenamed({base: "base", spans: "spans"})


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """Replace each span in `text` by its kind in brackets; spans that overlap become one, named by the first.

    Null text stays null; other columns stay as they are, also those named base or spans.
    """
    kinds = f"array({', '.join(f"'[{k.upper()}]'" for k in KINDS)})"

    def rewritten(spans: str, reach: str, blocks: str) -> str:
        starts = _over("transform", spans, lambda x, i: f"struct({x}.s as s, {x}.k as k, coalesce(get({reach}, {i} - 1), 0) as at)", 2)
        firsts = _over("filter", starts, lambda x: f"{x}.s >= {x}.at")
        parts = _over("transform", firsts, lambda x: f"concat({slice_of(blocks, f'{x}.at', f'{x}.s')}, get({kinds}, {x}.k))")
        return f"concat(array_join({parts}, ''), {slice_of(blocks, f'element_at({reach}, -1)', 'length(`text`)')})"

    def clean(spans: str) -> str:
        ends = _over("transform", spans, lambda x: f"{x}.e")
        cut = lambda reach: let(blocks_of("`text`"), lambda blocks: rewritten(spans, reach, blocks))
        new = let(ends, lambda e: let(_running(e, lambda x, y: f"greatest({x}, {y})"), cut))
        return f"if(size({spans}) > 0, {new}, `text`)"

    docs, base, spans = _with_spans(docs)
    return docs.withColumn("text", F.expr(let(spans, clean))).drop(base, spans)
