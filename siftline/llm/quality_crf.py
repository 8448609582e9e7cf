"""Document quality: a linear-chain conditional random field labels every line good or bad.

A line's features are its own shape (length, symbols, capitals, digits, punctuation, repeated words and
lines) and the shapes of the lines before and after it. The chain's forward-backward marginals, weighted
by line length, give the share of good text in a document; an isotonic map fitted on the same labelled
rows turns it into a probability. Lines carry no labels of their own: lines of good documents are good,
lines of bad documents start as bad, and those that a fitted chain finds clearly good are relabelled
before it is fitted again, as long as a bad line remains. Learning takes at most `max_labelled` labelled
rows of at most `max_lines` lines; scoring covers every row and whole texts in one scan, no shuffle.

Edge cases: a null or empty text is one empty line and scored like any other; blank lines are lines; a
null doc_id is scored; labels that are null or whose doc_id is missing aren't learned from; without
labelled rows every score is 0.5; repeated rows give repeated results; other columns are kept or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm._common import map_rows, slices, sum_of, text_array, words_of
from siftline.llm._labels import bucket, labelled_sample
from siftline.llm.boosting import Isotonic

MAX_LABELLED = 6000
MAX_LINES = 300
THRESHOLD = 0.3
OWN = 14
BESIDE = (1, 2, 3, 5, 7, 8, 10)
FEATURES = 1 + OWN + 2 * len(BESIDE) + 2
#: Lines whose features are held at once, and lines of a chain that is cut into blocks.
BLOCK = 100_000
LONG = 4096


def line_bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bytes, starts and ends of lines in them, and offsets of each text's lines."""
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([edges[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([edges[1:], breaks]), kind="stable")
    lines = np.searchsorted(breaks, edges[1:]) - np.searchsorted(breaks, edges[:-1]) + 1
    return data, starts, ends, np.concatenate([[0], np.cumsum(lines)])


def byte_classes() -> np.ndarray:
    """0 letter, 1 capital, 2 digit, 3 white space, 4 sentence punctuation, 5 other sign, 6 inner byte of a character."""
    table = np.full(256, 5, np.uint8)
    table[0xC3:] = 0
    table[0x80:0xC0] = 6
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t\r\n\x0b\x0c", 3), (".,;:!?'\"()-", 4)):
        table[[ord(c) for c in chars]] = kind
    return table


CLASSES = byte_classes()


def repeated_lines(texts: pa.Array, data: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each line occurs more than once in its text."""
    if not len(data):
        return np.zeros(len(starts), bool)
    same = _lines(data, starts).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    document = np.repeat(np.arange(len(texts)), np.diff(offsets))
    _, which, often = np.unique((document << 32) | same, return_inverse=True, return_counts=True)
    return often[which] > 1


def _lines(data: np.ndarray, starts: np.ndarray) -> pa.LargeStringArray:
    """The lines, line ends included; a text without a last newline ends where the next text starts, so a line runs to the start of the next."""
    edge = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(data)))


def own_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """The shapes of neighbouring lines (lines x OWN); data, starts and ends from the first of them on."""
    kinds = CLASSES[data]
    size = np.maximum(ends - starts, 0)

    def count(kind: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kinds == kind, dtype=np.int64)])
        return total[ends] - total[starts]

    small, capital, digit, _, point, sign = (count(k).astype(float) for k in range(6))
    letters = small + capital
    shown = np.maximum(letters + digit + point + sign, 1)
    if len(data):
        codes, at, _ = words_of(_lines(data, starts))
        words = np.diff(at).astype(float)
        line = np.repeat(np.arange(len(starts)), np.diff(at))
        again = np.zeros(len(codes))
        for lag in (1, 2):
            again[lag:] = np.maximum(again[lag:], (codes[lag:] == codes[:-lag]) & (line[lag:] == line[:-lag]))
        again = sum_of(again, at)
        pairs = np.unique((line << 32) | codes)
        distinct = np.bincount(pairs >> 32, minlength=len(starts)).astype(float)
    else:
        words = again = distinct = np.zeros(len(starts))
    repeated = repeated & (words > 0)
    w = np.maximum(words, 1)
    first, last = np.zeros(len(starts)), np.zeros(len(starts))
    full = size > 0
    if full.any():
        first[full] = kinds[starts[full]] == 1
        last[full] = np.isin(data[ends[full] - 1], [46, 33, 63])
    return np.stack([np.log1p(size), np.log1p(words), sign / shown, capital / np.maximum(letters, 1), digit / shown, point / shown, np.minimum(letters / w, 30) / 10, again / w, distinct / w, (words == 0).astype(float), repeated.astype(float), first, last, ((words > 0) & (words <= 3)).astype(float)], axis=1)


def feature_blocks(texts: pa.Array, most: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lines x FEATURES) of `most` neighbouring lines at a time, and of all lines the lengths in bytes and the offsets of each text's lines.

    A block needs the line before and the line after it; nothing else of its features depends on other blocks.
    """
    data, starts, ends, offsets = line_bounds(texts)
    most = most or BLOCK
    size = np.maximum(ends - starts, 0)
    repeated = repeated_lines(texts, data, starts, offsets)
    begin, end = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    begin[offsets[:-1]] = True
    end[offsets[1:] - 1] = True
    for a in range(0, len(starts), most):
        b = min(a + most, len(starts))
        low, high = max(a - 1, 0), min(b + 1, len(starts))
        to = starts[high] if high < len(starts) else len(data)
        own = own_features(data[starts[low] : to], starts[low:high] - starts[low], ends[low:high] - starts[low], repeated[low:high])
        near = own[:, BESIDE]
        before, after = np.zeros_like(near), np.zeros_like(near)
        before[1:], after[:-1] = near[:-1], near[1:]
        before[begin[low:high]], after[end[low:high]] = 0, 0
        x = np.concatenate([np.ones((high - low, 1)), own, before, after, begin[low:high, None], end[low:high, None]], axis=1)
        yield x[a - low : b - low], size, offsets


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x FEATURES), line lengths in bytes, offsets of each text's lines."""
    parts = list(feature_blocks(texts))
    if not parts:
        return np.zeros((0, FEATURES)), np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate([x for x, _, _ in parts]), *parts[0][1:]


class LineChain:
    """A two-state chain: state 1 is good. Emission score of good is x @ weights, that of bad 0."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.moves, self.mean, self.scale = weights, moves, mean, scale

    def emission(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def marginals(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return forward_backward(self.emission(x), offsets, self.moves)[0]


def forward_backward(score: np.ndarray, offsets: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good, expected moves (2 x 2), sum of log normalisers; all chains advance together, longest first."""
    n = np.diff(offsets)
    alpha, beta = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    emit = np.stack([np.zeros_like(score), score], axis=1)
    for i in np.flatnonzero(n > LONG):
        own = slice(offsets[i], offsets[i + 1])
        alpha[own] = long_alphas(emit[own], moves)
        beta[own] = long_alphas(emit[own][::-1], moves.T)[::-1] - emit[own]
    order = np.argsort(-n, kind="stable")
    starts, n = offsets[:-1][order], n[order]
    ends = starts + n - 1
    n = np.where(n > LONG, 0, n)
    by_length = np.argsort(-n, kind="stable")
    starts, n = starts[by_length], n[by_length]
    steps = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(steps), side="left")
    for t in range(steps):
        at = starts[: live[t]] + t
        if t:
            back = alpha[at - 1]
            alpha[at] = np.logaddexp(back[:, :1] + moves[0], back[:, 1:] + moves[1]) + emit[at]
        else:
            alpha[at] = emit[at]
    for t in range(steps - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        ahead = beta[at + 1] + emit[at + 1]
        beta[at] = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
    norm = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    each = np.empty(len(score))
    each[:] = np.repeat(norm[np.argsort(order, kind="stable")], np.diff(offsets))
    good = np.exp(np.clip(alpha[:, 1] + beta[:, 1] - each, -700, 0))
    inner = np.ones(len(score), bool)
    inner[ends] = False
    at = np.flatnonzero(inner)
    expected = np.exp(np.minimum(alpha[at][:, :, None] + moves[None] + (emit[at + 1] + beta[at + 1])[:, None, :] - each[at][:, None, None], 0)).sum(axis=0)
    return good, expected, float(norm.sum())


def long_alphas(emit: np.ndarray, moves: np.ndarray, block: int = 512) -> np.ndarray:
    """Forward scores of one long chain: its blocks advance together, first from either state, then from what the block before ended with."""
    n, blocks = len(emit), -(-len(emit) // block)
    e = np.zeros((blocks * block, 2))
    e[:n] = emit
    e = e.reshape(blocks, block, 2)
    step = lambda a, at: np.logaddexp(a[..., :1] + moves[0], a[..., 1:] + moves[1]) + at
    # from[b, s]: scores at the end of block b if the place before it is in state s
    through = np.full((blocks, 2, 2), -np.inf)
    through[:, [0, 1], [0, 1]] = 0
    for t in range(block):
        through = step(through, e[:, None, t])
    before = np.empty((blocks, 2))
    now = emit[0]
    for t in range(1, min(block, n)):
        now = step(now, e[0, t])
    for b in range(1, blocks):
        before[b] = now
        now = np.logaddexp(now[0] + through[b, 0], now[1] + through[b, 1])
    out = np.empty((blocks, block, 2))
    a = step(before, e[:, 0])
    a[0] = emit[0]
    for t in range(block):
        a = step(a, e[:, t]) if t else a
        out[:, t] = a
    return out.reshape(-1, 2)[:n]


def fit_chain(x: np.ndarray, offsets: np.ndarray, y: np.ndarray, rounds: int = 3, steps: int = 60) -> LineChain:
    """Conditional likelihood by Adam; y: 1 for good documents. Lines of bad documents are relabelled between rounds."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[0], scale[0] = 0, 1
    z = (x - mean) / scale
    document = np.repeat(np.arange(len(y)), np.diff(offsets))
    label = y[document].astype(float)
    theta = np.zeros(z.shape[1] + 4)
    inner = np.ones(len(z), bool)
    inner[offsets[1:] - 1] = False
    at = np.flatnonzero(inner)
    for round_ in range(rounds):
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[at].astype(int), label[at + 1].astype(int)), 1)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            good, expected, _ = forward_backward(z @ theta[:-4], offsets, theta[-4:].reshape(2, 2))
            grad = np.concatenate([z.T @ (label - good), (seen - expected).ravel()]) / len(z) - 1e-4 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        if round_ + 1 < rounds:
            good, _, _ = forward_backward(z @ theta[:-4], offsets, theta[-4:].reshape(2, 2))
            fresh = np.where(y[document] == 1, 1.0, (good > 0.9).astype(float))
            none_bad = sum_of(1 - fresh, offsets) == 0
            label = np.where((none_bad & (y == 0))[document], 0.0, fresh)
    return LineChain(theta[:-4], theta[-4:].reshape(2, 2), mean, scale)


def share_of_good(good: np.ndarray, size: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    weight = size + 1.0
    return sum_of(good * weight, offsets) / sum_of(weight, offsets)


class QualityModel:
    def __init__(self, chain: LineChain | None, calibration: Isotonic):
        self.chain, self.calibration = chain, calibration

    def share(self, texts: pa.Array) -> np.ndarray:
        scores, size, offsets = [], np.zeros(0, np.int64), np.zeros(1, np.int64)
        for x, size, offsets in feature_blocks(texts):
            scores.append(self.chain.emission(x))
        good = forward_backward(np.concatenate([*scores, np.zeros(0)]), offsets, self.chain.moves)[0]
        return share_of_good(good, size, offsets)

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.calibration(self.share(texts)) if self.chain else np.full(len(texts), 0.5)


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", max_labelled: int = MAX_LABELLED, max_lines: int = MAX_LINES) -> QualityModel:
    sample = labelled_sample(docs, labels, label, train, max_labelled)
    sample = sample.where(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\n]", "")) < max_lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, size, offsets = line_features(text_array(batch.column(1)))
            blobs = [x[a:b].astype(np.float32).tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
            sizes = [size[a:b].astype(np.int64).tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), pa.array(sizes, pa.binary())], names=["y", "x", "size"])

    rows = sorted(sample.select("y", "text").mapInArrow(run, "y int, x binary, size binary").collect(), key=lambda r: (r["y"], bytes(r["x"])))
    if not rows:
        return QualityModel(None, Isotonic())
    parts = [np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, FEATURES) for r in rows]
    x, y = np.concatenate(parts).astype(float), np.array([r["y"] for r in rows])
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    size = np.concatenate([np.frombuffer(bytes(r["size"]), np.int64) for r in rows])
    chain = fit_chain(x, offsets, y)
    return QualityModel(chain, Isotonic().fit(share_of_good(chain.marginals(x, offsets), size, offsets), y.astype(float)))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted beside their columns (or in place of columns of these names)."""
    kept = docs.drop("score", "predicted")
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            score = model.score(text_array(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names, "a0", "a1"])

    return map_rows(kept, run, {"score": "double", "predicted": "int"})


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels, bucket("doc_id", 5) != 0)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
