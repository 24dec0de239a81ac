"""Fill-in-middle: texts cut in three at token borders that run-length encoded character classes locate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands before the parts of a transformed text; a text that holds one of these stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that are classified at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Runs:
    """Maximal runs of one character class, in order.

    A run of letters A-Z, a-z is one unit, whatever its length; in a run of other code points
    each is a unit. `start` is the code point at which a run begins, `units` how many units lie
    before it, and both end with the totals; `letters` tells the class.
    """

    start: np.ndarray
    units: np.ndarray
    letters: np.ndarray

    @staticmethod
    def of(text: str) -> Runs:
        """Texts are classified block by block; a run that goes on in the next block stays one run."""
        borders, kinds, last = [], [], None
        for at in range(0, len(text), BLOCK):
            points = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
            folded = points | 32
            letter = (folded >= 97) & (folded <= 122) & (points < 128)
            change = np.flatnonzero(letter[1:] != letter[:-1]) + 1
            if last is None or letter[0] != last:
                change = np.concatenate(([0], change))
            borders.append(change + at)
            kinds.append(letter[change])
            last = letter[-1]
        start = np.concatenate([*borders, [len(text)]]).astype(np.int64)
        letters = np.concatenate([*kinds, []]).astype(bool)
        return Runs(start, np.concatenate(([0], np.cumsum(np.where(letters, 1, np.diff(start))))), letters)

    @property
    def n(self) -> int:
        return int(self.units[-1])

    def offset(self, cut: int) -> int:
        """The code point behind the first `cut` units: binary search for the run, then arithmetic within it."""
        if cut >= self.n:
            return int(self.start[-1])
        run = int(np.searchsorted(self.units, cut, "right")) - 1
        return int(self.start[run]) + (cut - int(self.units[run]))  # a letter run holds one unit, so the difference is 0 there


@dataclass(frozen=True)
class Rates:
    """Of 100 texts so many are transformed, and of 100 of those so many with the suffix in front."""

    transformed: int = 90
    suffix_first: int = 20


def joined(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "plain":
        return prefix + middle + suffix
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    if form == "spm":
        return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    raise ValueError(f"unknown form {form!r}")


def restored(form: str, output: str) -> str:
    """The text that joined() was given; markers are found from the left, as parts hold none and none can arise at a border."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if form not in ("psm", "spm") or not output.startswith(first):
        raise ValueError(f"not a text of form {form!r}")
    at = output.index(second, len(first))
    end = output.index(MIDDLE, at + len(second))
    one, two, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(MIDDLE) :]
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def transform(text: str, key: str, rates: Rates = Rates()) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text; cuts and form follow from the SHA-256 of `key`."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    runs = Runs.of(text)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rates.transformed:
        return runs.n, "plain", None, None, text
    low, high = sorted((runs.offset(h1 % (runs.n + 1)), runs.offset(h2 % (runs.n + 1))))
    form = "spm" if h4 % 100 < rates.suffix_first else "psm"
    return runs.n, form, low, high - low, joined(form, text[:low], text[low:high], text[high:])


NAMES = ("fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output")
TYPES = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string())


def _transformed(batches: Iterator[pa.RecordBatch], seed: int, rates: Rates, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Batches with the columns of NAMES behind their own; a batch of very long texts is handed on in parts."""
    for batch in batches:
        rows, size, first = [], 0, 0
        for i, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"))):
            text = text.as_py() or ""
            rows.append(transform(text, f"{seed}:{'' if doc_id is None else doc_id}", rates))
            size += len(text)
            if size > most or i + 1 == batch.num_rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), TYPES)]
                own = batch.slice(first, len(rows))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), *columns], ["doc_id", *NAMES])
                rows, size, first = [], 0, i + 1


def fill_in_middle(docs: DataFrame, seed: int = 1, rates: Rates = Rates()) -> DataFrame:
    """(doc_id, text) -> doc_id, n, form, prefix_chars, middle_chars, output: each text rearranged for infilling.

    n counts the tokens `[A-Za-z]+|[^A-Za-z]` of the whole text. The prefix ends behind the
    smaller of two token numbers drawn from the SHA-256 of `seed:doc_id`, the middle behind the
    larger. A map over rows: nothing is shuffled. Null text counts as empty, and an empty text
    stays plain; rows without doc_id draw from `seed:`; equal rows give equal results; other
    columns are not read; an empty table gives no row. Text is held whole, its code points in
    blocks.
    """
    ddl = "doc_id long, fim_n long, fim_form string, fim_prefix_chars long, fim_middle_chars long, fim_output string"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(partial(_transformed, seed=seed, rates=rates), ddl)
    return made.select("doc_id", *[F.col(name).alias(name.removeprefix("fim_")) for name in NAMES])


def restore_texts(made: DataFrame) -> DataFrame:
    """The texts, rebuilt from `form` and `output` alone, as column `restored`; native."""
    out, form = F.col("output"), F.col("form")

    def parts(first: str, second: str):
        at = F.locate(second, out, len(first) + 1)
        end = F.call_function("locate", F.lit(MIDDLE), out, at + len(second))
        return (
            F.substring(out, F.lit(len(first) + 1), at - (len(first) + 1)),
            F.substring(out, at + len(second), end - at - len(second)),
            F.substring(out, end + len(MIDDLE), F.length(out)),
        )

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix2, prefix2, middle2 = parts(SUFFIX, PREFIX)
    text = F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(out)
    return made.withColumn("restored", text)


ORACLE = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
units AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u FROM docs),
drawn AS (SELECT *, CAST(len(u) AS BIGINT) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
