"""Cost-balanced packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import partial
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("sequence_cost", pa.float64()),
        ("ids", pa.binary()),
    ]
)
PIECES_DDL = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_cost double, ids binary"
)
#: Words whose ids one Python worker remembers from task to task; the memory is emptied when it is full.
REMEMBERED_WORDS = 500_000
#: Punctuation that is encoded apart from a letter or digit before it, unless that becomes more than a letter in lower case.
TRAILING = ".,;:?!*$%&#|"


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[int, str]:
    """The characters by which byte-level BPE writes bytes: those of Latin-1 that are seen, and 256 onwards for the others."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in seen]
    return {b: chr(256 + i) for i, b in enumerate(other)}


_BYTE_CHARS = _byte_chars()


class WordIds(dict):
    """Ids of words as little-endian unsigned 32-bit bytes; a word that is missing is encoded when it is asked for.

    Words that differ in trailing punctuation or ASCII case only share what is encoded.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.remembered = remembered

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(TRAILING)
        if len(core) < len(word) and core and core[-1].isalnum() and (core.isascii() or self._letters(core)):
            ids = self[core] + self[word[len(core) :]]
        elif word.isascii() and not word.islower() and word.lower() != word:
            ids = self[word.lower()]
        else:
            ids = self._encoded(word)
        if len(self) >= self.remembered:
            self.clear()
        self[word] = ids
        return ids

    @staticmethod
    def _letters(word: str) -> str:
        """The word in lower case if that is all letters and composes to itself, else nothing."""
        lower = "".join([c.lower() for c in word])
        return lower if lower.isalpha() and is_normalized("NFC", word) else ""

    def _encoded(self, word: str) -> bytes:
        """A word of letters, which the tokenizer does not split, goes to its merges directly."""
        if word.isalpha():
            if word.isascii():
                return array("I", [token.id for token in self.merges(word)]).tobytes()
            lower = self._letters(word)
            if lower:
                written = lower.encode().decode("latin-1").translate(_BYTE_CHARS)
                return array("I", [token.id for token in self.merges(written)]).tobytes()
        return self.whole(word)


class WordEncoder:
    """Ids of texts, word by word, as little-endian unsigned 32-bit bytes.

    Valid for tokenizers that split at white space before merging: the ids of a text are
    then those of its words in a row. Only space and newline, which count as white space
    everywhere, are split at here; all else is left to the tokenizer. A text that could
    hold one of the tokenizer's special tokens is encoded as a whole. The tokenizer is also
    taken to compose and lower-case characters, to part letters from punctuation, and to
    merge the bytes of a run of letters, as word_bpe_49k does.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS):
        self.words = WordIds(path, remembered)

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            return self.words.whole(text)
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """This process's encoder; what it remembers never changes the ids."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def powers_of_two(n: int) -> list[int]:
    """n as a sum of different powers of two, largest first."""
    return [1 << bit for bit in range(n.bit_length() - 1, -1, -1) if n >> bit & 1]


def assign(lengths: list[int], capacities: list[int], linear: float, quadratic: float):
    """Assign documents, longest first, to the cheapest sequence that has room; returns the sequences and what is over.

    The cost of a piece of n tokens is linear * n + quadratic * n * n, that of a sequence the
    sum over its pieces. A document that fits nowhere is cut: the cheapest sequence with any
    room takes what it can, and the rest goes on. So every sequence gets full unless the
    documents run out. Each sequence is a list of (document, start, length).
    """
    room = np.array(capacities, np.int64)
    cost = np.zeros(len(capacities))
    bins: list[list[tuple[int, int, int]]] = [[] for _ in capacities]
    over = []
    left = int(room.sum())
    for doc in np.argsort(-np.array(lengths, np.int64), kind="stable").tolist():
        start, rest = 0, lengths[doc]
        while rest:
            if not left:
                over.append((doc, start, rest))
                break
            open_to = np.where(room >= rest, cost, np.inf)
            at = int(open_to.argmin())
            if open_to[at] == np.inf:
                at = int(np.where(room > 0, cost, np.inf).argmin())
            took = min(rest, int(room[at]))
            bins[at].append((doc, start, took))
            room[at] -= took
            left -= took
            cost[at] += linear * took + quadratic * took * took
            start, rest = start + took, rest - took
    return bins, cost, over


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, length: int, window: int, linear: float, quadratic: float):
    encoder, end = encoder_for(path), np.array([end_id], "<u4").tobytes()
    context = TaskContext.get()
    next_id = (context.partitionId() if context else 0) << 36
    pool: list[tuple[int | None, int, bytes, int]] = []  # doc_id, start, ids, the document's tokens
    rows: list[tuple] = []
    pooled = size = 0

    def put(sequence: list[tuple[int | None, int, bytes, int]], cost: float) -> None:
        nonlocal next_id, size
        offset = 0
        for doc_id, start, ids, total in sequence:
            n = len(ids) // 4
            rows.append((doc_id, start, n, total, next_id, offset, cost, ids))
            offset += n
            size += len(ids)
        next_id += 1

    def emptied() -> pa.RecordBatch:
        nonlocal size
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)
        rows.clear()
        size = 0
        return out

    def flush(last: bool) -> None:
        nonlocal pool, pooled
        capacities = [length] * (pooled // length) + (powers_of_two(pooled % length) if last else [])
        bins, costs, over = assign([len(p[2]) // 4 for p in pool], capacities, linear, quadratic)
        cut = lambda doc, start, n: (pool[doc][0], pool[doc][1] + start, pool[doc][2][4 * start : 4 * (start + n)], pool[doc][3])
        for pieces, cost in zip(bins, costs.tolist()):
            put([cut(*piece) for piece in pieces], cost)
        pool = [cut(*piece) for piece in over]
        pooled = sum(len(p[2]) // 4 for p in pool)

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = encoder.encode(text or "") + end
            total = len(ids) // 4
            whole = total // length * length
            for start in range(0, whole, length):
                put([(doc_id, start, ids[4 * start : 4 * (start + length)], total)], linear * length + quadratic * length * length)
            if whole < total:
                pool.append((doc_id, whole, ids[4 * whole :], total))
                pooled += total - whole
            if pooled >= window:
                flush(False)
            if size > 1 << 22:
                yield emptied()
    flush(True)
    if rows:
        yield emptied()


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    end_id: int = 2,
    length: int = 4096,
    window: int = 1 << 20,
    linear: float = 1.0,
    quadratic: float = 1.0 / 4096,
) -> DataFrame:
    """Pack the tokens of (doc_id, text) into sequences of at most `length` tokens, a row for each piece.

    Each task packs the rows it reads, with no shuffle: it tokenises them, gives every full
    `length` tokens of a long document a sequence of their own, and pools the rest. Whenever
    `window` tokens are pooled, `assign` fills pooled // length sequences; what is over stays
    in the pool. At the end of a task's rows the last pooled tokens go to sequences whose
    sizes are different powers of two, which need no padding. A task holds `window` tokens and
    one batch of rows at most, besides its longest document.

    Null text counts as empty; every document ends with `end_id`, so an empty one is one piece
    of one token. Null and repeated doc_id are packed as they come, each row on its own. Other
    columns are not read. An empty table gives no row. sequence_id is unique, not dense, and
    the same whenever the input has the same partitions. `ids` holds little-endian unsigned
    32-bit token ids, sequence_cost the estimated cost of the piece's sequence.
    """
    run = partial(
        _pack, path=tokenizer_path or tokenizer_file(), end_id=end_id, length=length, window=window, linear=linear, quadratic=quadratic
    )
    return docs.select("doc_id", "text").mapInArrow(run, PIECES_DDL)
