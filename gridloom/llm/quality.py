"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: The model learns from so many labelled documents at most, those with the smallest hash of their doc_id.
TRAINING_DOCS = 3000
#: Longer texts (in bytes) are not learned from.
TRAINING_BYTES = 1 << 16
#: Classes of bytes that are counted in each line.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t",
    "stop": b".",
    "comma": b",;:",
    "mark": b"!?",
    "bar": b"|\\<>{}[]=_~^",
    "symbol": b"*$%&#@+/",
    "quote": b"\"'()-`",
    "high": bytes(range(128, 256)),
}
N_OWN = len(CLASSES) + 7


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int64)
    for i, chars in enumerate(CLASSES.values()):
        table[np.frombuffer(chars, np.uint8)] = i
    return table


_CLASS_OF = _class_table()


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in a row with newlines between: bytes, starts and ends of the lines, lines of every text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    of_text = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    return data, starts, ends, np.diff(np.concatenate(([-1], np.searchsorted(ends, of_text))))


def _own_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: int, high: int, step: int = 1 << 19) -> np.ndarray:
    """What lines low to high tell by themselves; counts of byte classes come from histograms over (line, class) of `step` bytes."""
    k = len(CLASSES) + 1
    counts = np.zeros((high - low, k))
    for at in range(int(starts[low]), int(ends[high - 1]) + 1, step):
        stop = min(at + step, int(ends[high - 1]) + 1)
        first, last = np.searchsorted(ends, at), np.searchsorted(ends, stop - 1) + 1
        held = np.minimum(ends[first:last] + 1, stop) - np.maximum(starts[first:last], at)
        keys = np.repeat(np.arange(last - first) * k, held) + _CLASS_OF[data[at:stop]]
        counts[first - low : last - low] += np.bincount(keys, minlength=(last - first) * k).reshape(last - first, k)
    starts, ends = starts[low:high], ends[low:high]
    sizes = ends - starts
    counts = counts[:, : len(CLASSES)]
    share = counts / np.maximum(sizes, 1)[:, None]
    names = list(CLASSES)
    words = counts[:, names.index("space")] + 1
    letters = counts[:, names.index("upper")] + counts[:, names.index("lower")] + counts[:, names.index("high")]
    first = data[np.minimum(starts, len(data) - 1)]
    last = data[np.maximum(ends - 1, 0)]
    per_word = lambda name: np.minimum(counts[:, names.index(name)] / words, 3)
    return np.column_stack(
        [
            share * 4,
            np.minimum(letters / words, 20) / 10,
            np.log1p(sizes) / 5,
            (sizes == 0).astype(float),
            per_word("symbol"),
            per_word("mark"),
            per_word("bar"),
            ((first >= 97) & (first <= 122)).astype(float) + 2.0 * ((last == 46) & (sizes > 0)),
        ]
    )


def _beside(own: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the lines before and behind each, zero where the text has none."""
    before, behind = np.zeros_like(own), np.zeros_like(own)
    before[1:], behind[:-1] = own[:-1], own[1:]
    last = np.cumsum(lines) - 1
    before[last[:-1] + 1], behind[last] = 0, 0
    return before, behind


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, bytes of every line, lines of every text); an empty text is one empty line.

    The features of a line are its own and those of the lines before and behind it in the
    same text, zero where there is none.
    """
    data, starts, ends, lines = _laid_out(texts)
    own = _own_features(data, starts, ends, 0, len(ends))
    return np.column_stack([own, *_beside(own, lines), np.ones(len(own))]), ends - starts, lines


def line_scores(texts: list[bytes], weights: np.ndarray, at_once: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features(texts) @ weights, bytes of every line, lines of every text, with the features of `at_once` lines in memory."""
    data, starts, ends, lines = _laid_out(texts)
    parts = weights[:-1].reshape(3, N_OWN).T
    scores = np.empty((len(ends), 3))
    for low in range(0, len(ends), at_once):
        high = min(low + at_once, len(ends))
        scores[low:high] = _own_features(data, starts, ends, low, high) @ parts
    good = scores[:, 0] + weights[-1] + _beside(scores[:, 1], lines)[0]
    return good + _beside(scores[:, 2], lines)[1], ends - starts, lines


def _through(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Log-weights of two states after a transition: log(exp(a) exp(m)) over the last axis."""
    return np.stack([np.logaddexp(a[..., 0] + m[0, j], a[..., 1] + m[1, j]) for j in (0, 1)], axis=-1)


def forward_backward(good: np.ndarray, lines: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with the line's own score) and backward log-weights of the states of every line.

    Texts are cut into blocks of about the square root of the longest one's lines, and blocks
    run side by side. What a block does as a whole is a 2 x 2 matrix, which leads from block
    to block; so a text of n lines takes a few times sqrt(n) steps.
    """
    block = max(64, int(np.ceil(np.sqrt(lines.max(initial=1)))))
    blocks = -(-lines // block)
    first_block = np.cumsum(blocks) - blocks
    k = np.arange(blocks.sum()) - np.repeat(first_block, blocks)
    starts = np.repeat(np.cumsum(lines) - lines, blocks) + k * block
    sizes = np.minimum(block, np.repeat(lines, blocks) - k * block)
    order = np.argsort(-sizes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    starts, sizes, opens = starts[order], sizes[order], (k == 0)[order]
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
    entry, leave = np.zeros((len(order), 2)), np.zeros((len(order), 2))
    if blocks.max(initial=1) > 1:
        whole = np.broadcast_to(np.where(np.eye(2) == 1, 0.0, -1e30), (len(order), 2, 2)).copy()
        for t, n in enumerate(active):
            moved = _through(whole[:n], moves)
            if t == 0:
                moved[opens[:n]] = whole[:n][opens[:n]]  # nothing leads to a text's first line
            moved[:, :, 1] += good[starts[:n] + t][:, None]
            whole[:n] = moved
        for at in range(1, int(blocks.max())):
            texts = first_block[blocks > at]
            here, behind = place[texts + at], place[texts + at - 1]
            entry[here] = np.logaddexp(entry[behind, 0][:, None] + whole[behind, 0], entry[behind, 1][:, None] + whole[behind, 1])
        for at in range(int(blocks.max()) - 1, 0, -1):
            texts = first_block[blocks > at]
            here, behind = place[texts + at], place[texts + at - 1]
            leave[behind] = np.logaddexp(whole[here, :, 0] + leave[here, :1], whole[here, :, 1] + leave[here, 1:])
    forward, backward = np.empty((len(good), 2)), np.empty((len(good), 2))
    a = entry
    for t, n in enumerate(active):
        moved = _through(a[:n], moves)
        if t == 0:
            moved[opens[:n]] = 0.0
        moved[:, 1] += good[starts[:n] + t]
        a = forward[starts[:n] + t] = moved
    for t in range(len(active) - 1, -1, -1):
        ahead = int(active[t + 1]) if t + 1 < len(active) else 0
        b = leave[:ahead].copy()
        b[:, 1] += good[starts[:ahead] + t + 1]
        leave[:ahead] = _through(b, moves.T)
        backward[starts[: active[t]] + t] = leave[: active[t]]
    return forward, backward


@dataclass(frozen=True)
class LineCrf:
    """States 0 (bad) and 1 (good): emission weights of good against bad, transitions, and the calibration of documents."""

    weights: np.ndarray
    moves: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    empty: float = 0.5

    def marginals(self, good: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """P(good) of every line of given scores."""
        both = np.add(*forward_backward(good, lines, self.moves))
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))

    def raw(self, good: np.ndarray, sizes: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """The length-weighted mean of the marginals of each text's lines."""
        p = self.marginals(good, lines)
        starts = np.concatenate(([0], np.cumsum(lines)[:-1])).astype(int)
        weight = sizes.astype(float)
        total = np.add.reduceat(weight, starts)
        mean = np.add.reduceat(p * weight, starts) / np.maximum(total, 1)
        return np.where(total > 0, mean, np.nan)

    def score(self, texts: list[bytes]) -> np.ndarray:
        raw = self.raw(*line_scores(texts, self.weights))
        logit = np.log(np.clip(raw, 1e-6, 1 - 1e-6) / np.clip(1 - raw, 1e-6, 1 - 1e-6))
        return np.where(np.isnan(raw), self.empty, 1 / (1 + np.exp(-(self.scale * logit + self.shift))))


def _expected_pairs(good: np.ndarray, lines: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the probabilities (i, j) of the states of every line but the first of a text and the one before."""
    forward, backward = forward_backward(good, lines, moves)
    second = np.ones(len(good), bool)
    second[np.cumsum(lines) - lines] = False
    at = np.flatnonzero(second)
    ahead = backward[at] + np.column_stack([np.zeros(len(at)), good[at]])
    joint = forward[at - 1][:, :, None] + moves + ahead[:, None, :]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    both = forward + backward
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60))), joint / joint.sum(axis=(1, 2), keepdims=True)


def fit_crf(texts: list[bytes], good: np.ndarray, rounds: int = 120, rate: float = 0.1, decay: float = 1e-3, noise: float = 0.1) -> LineCrf:
    """Fit emissions and transitions by maximum likelihood with Adam; the labels of lines are latent.

    A line has its document's label but for a share `noise`; the gradient is what the field
    expects of lines and of pairs of lines given the document's label, less what it expects
    without. Lines are weighted by their length, as they are in the aggregate, pairs evenly
    within a document, and documents of both labels weigh the same. Then the logit of the
    aggregate is calibrated to the labels by logistic regression.
    """
    x, sizes, lines = line_features(texts)
    starts = np.concatenate(([0], np.cumsum(lines)[:-1])).astype(int)
    share = sizes / np.maximum(np.add.reduceat(sizes.astype(float), starts).repeat(lines), 1)
    balance = np.where(good == 1, 0.5 / max(good.mean(), 1e-6), 0.5 / max(1 - good.mean(), 1e-6))
    weight = share * np.repeat(balance, lines)
    pair_weight = np.repeat(balance / np.maximum(lines - 1, 1), np.maximum(lines - 1, 0))
    told = np.repeat(np.where(good == 1, 1.0, -1.0), lines) * np.log(1 / noise - 1)
    n, k = len(good), x.shape[1]
    theta, mean, square = np.zeros(k + 4), np.zeros(k + 4), np.zeros(k + 4)
    for t in range(1, rounds + 1):
        scores, moves = x @ theta[:k], theta[k:].reshape(2, 2)
        free, free_pairs = _expected_pairs(scores, lines, moves)
        given, given_pairs = _expected_pairs(scores + told, lines, moves)
        grad = np.concatenate([((given - free) * weight) @ x, np.tensordot(pair_weight, given_pairs - free_pairs, 1).ravel()]) / n - decay * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        theta = theta + rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    w, moves = theta[:k], theta[k:].reshape(2, 2)
    raw = LineCrf(w, moves).raw(x @ w, sizes, lines)
    known = ~np.isnan(raw)
    logit, z = np.log(np.clip(raw, 1e-6, 1 - 1e-6) / np.clip(1 - raw, 1e-6, 1 - 1e-6))[known], good[known]
    scale, shift = 1.0, 0.0
    for _ in range(25):  # Newton steps of a slightly regularised logistic regression
        p = 1 / (1 + np.exp(-np.clip(scale * logit + shift, -30, 30)))
        h = p * (1 - p)
        a = np.array([[(h * logit * logit).sum() + 1, (h * logit).sum()], [(h * logit).sum(), h.sum() + 1]])
        b = np.array([((z - p) * logit).sum() - (scale - 1), (z - p).sum() - shift])
        step = np.linalg.solve(a, b)
        scale, shift = scale + step[0], shift + step[1]
    return LineCrf(w, moves, float(scale), float(shift), float(good.mean()) if len(good) else 0.5)


def held_out(doc_id: Column) -> Column:
    """True for documents that training must not see; null is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _utf8(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _scores(batches: Iterator[pa.RecordBatch], model: LineCrf, without: str | None, name: str, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _utf8(batch.column("text"))
        found, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= most_bytes):
                size += len(texts[end])
                end += 1
            found.append(model.score(texts[at:end]))
            at = end
        scores = np.concatenate(found) if found else np.empty(0)
        kept = [i for i, column in enumerate(batch.schema.names) if column != without]
        names = [batch.schema.names[i] for i in kept]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(scores)], [*names, name])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCS, most_bytes: int = TRAINING_BYTES) -> LineCrf:
    """Fit on `most` labelled documents of `most_bytes` bytes at most, none of them held out.

    The labels are chosen first, by a hash of doc_id, so that the join's small side is bounded;
    then at most `most` texts reach the driver, also where a doc_id repeats. With no labels,
    or one label only, every document scores the share of good labels (0.5 without any).
    """
    chosen = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(most).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))
    good = np.array([float(r["quality"] == 1) for r in rows])
    texts = [(r["text"] or "").encode("utf-8", "surrogatepass") for r in rows]
    if len(set(good.tolist())) < 2:
        share = float(good.mean()) if len(good) else 0.5
        logit = float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1 - 1e-3)))
        return LineCrf(np.zeros(3 * N_OWN + 1), np.zeros((2, 2)), 0.0, logit, share)
    return fit_crf(texts, good)


def score_documents(docs: DataFrame, model: LineCrf) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, score, predicted.

    Nothing but the text enters a score. Null and empty texts, which have no line with any
    length, score the share of good documents the model was fitted on. Every row is scored on
    its own, so nulls and repeats in other columns do not matter; they are not read.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(partial(_scores, model=model, without="text", name="score"), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, model: LineCrf) -> DataFrame:
    """The rows of docs that score 0.5 or more, with all their columns, whatever these are named."""
    score = f"score_{uuid.uuid4().hex}"
    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])
    return docs.mapInArrow(partial(_scores, model=model, without=None, name=score), schema).where(F.col(score) >= 0.5).drop(score)
