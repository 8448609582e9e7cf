"""Toxicity: boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labelled rows: words and word beginnings whose document frequency differs
most between the classes. Features of a text are lexicon densities and counts, hits near second-person
words, capitals, punctuation, stretched letters, and hits that appear only after undoing digit and
punctuation disguises. Both models learn from a bounded sample of labelled rows (`max_labelled`, in
hash order of doc_id); scoring covers every row and every whole text, with one scan and no shuffle.

Edge cases: a null or empty text has all-zero features and a score like any other; a null doc_id is
scored and not held out; a label that is null, or whose doc_id is missing from the documents, is not
learned from; of several labels of a doc_id the largest counts; without labelled rows every score is
0.5; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm._common import SMALL_SLICE, bound_batches, map_rows, slices, sum_of, text_array, trimmed, words_of, write_out
from siftline.llm._labels import bucket, labelled_sample
from siftline.llm.boosting import BoostedTrees, Isotonic

MAX_LABELLED = 20_000
LEXICON = 400
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
NEAR = 4

# Second-person words of the languages covered (fixed values).
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie usted ustedes ti tus vosotros vuestro".split())
# Digits and signs that stand for letters (fixed values).
DISGUISE = str.maketrans("013457@$!|+", "oieastasiit")
LETTERS = re.compile(r"[^\W\d_]+")
STRETCH = re.compile(r"([^\W\d_])\1\1")
FEATURES = 18


class WordTable:
    """Numbers of each distinct word under one lexicon; a bounded memory keeps those already worked out."""

    WIDTH = 11

    def __init__(self, lexicon: dict[str, float], keep: int = 200_000):
        self.lexicon, self.keep = lexicon, keep
        self.known: dict[str, int] = {}  # rows of the matrix
        self.rows = np.empty((0, self.WIDTH))

    def look(self, word: str) -> tuple[float, ...]:
        low = word.lower()
        runs = LETTERS.findall(low)
        core = max(runs, key=len) if runs else ""
        get = self.lexicon.get
        whole = get("w" + core, 0.0)
        start = max((get(f"p{core[:p]}", 0.0) for p in PREFIXES if len(core) >= p), default=0.0)
        hidden = 0.0
        if not whole and len(low) > 2 and not low.isalpha():
            plain = "".join(LETTERS.findall(low.strip(".,;:!?\"'()").translate(DISGUISE)))
            if plain != core:
                hidden = get("w" + plain, 0.0)
        letters = sum(map(len, runs))
        upper = sum(c.isupper() for c in word)
        return (whole, start, hidden, float(core in SECOND), float(letters > 1 and upper == letters), float(upper), float(letters), float(len(word) - letters), float(word.count("!")), float(bool(STRETCH.search(low))), float(any(c.isdigit() for c in word)))

    def of(self, words: list[str]) -> np.ndarray:
        """(words x WIDTH) numbers."""
        if len(self.known) + len(words) > len(self.rows):
            self.known.clear()
            if len(words) > len(self.rows):
                self.rows = np.empty((max(len(words), self.keep), self.WIDTH))
        known, look, rows = self.known, self.look, self.rows
        at = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            row = known.get(w)
            if row is None:
                row = known[w] = len(known)
                rows[row] = look(w)
            at[i] = row
        return rows[at]


def features(texts: pa.Array, table: WordTable) -> np.ndarray:
    codes, offsets, distinct = words_of(texts)
    numbers = table.of(distinct.to_pylist())
    n = np.diff(offsets)
    per = np.maximum(n, 1)
    out = np.zeros((len(texts), FEATURES))
    if not len(codes):
        return out
    total = lambda v: sum_of(v, offsets)
    column = lambda j: numbers[:, j][codes]

    def most(v: np.ndarray) -> np.ndarray:
        top = np.zeros(len(n))
        full = np.flatnonzero(n)
        top[full] = np.maximum.reduceat(v, offsets[:-1][full])
        return top

    whole, start, hidden, second = (column(j) for j in range(4))
    hit = (whole > 0) | (hidden > 0)
    spoken = np.concatenate([[0], np.cumsum(second)])
    at = np.flatnonzero(hit)
    text = np.searchsorted(offsets, at, side="right") - 1
    beside = np.zeros(len(codes))
    beside[at] = spoken[np.minimum(at + NEAR + 1, offsets[text + 1])] - spoken[np.maximum(at - NEAR, offsets[text])] > 0
    hits = total(hit.astype(float))
    starts = total((start > 0).astype(float))
    letters = np.maximum(total(column(6)), 1)
    parts = [
        np.log1p(n), total(np.maximum(whole, hidden)) / per, most(np.maximum(whole, hidden)), hits / per, np.log1p(hits), total(start) / per, most(start), starts / per, np.log1p(starts),
        total((hidden > 0).astype(float)), total(second) / per, total(beside), total(column(4)) / per, total(column(5)) / letters, total(column(7)) / per, total(column(8)) / per, total(column(9)) / per, total(column(10)) / per,
    ]
    return np.stack(parts, axis=1)


def _starts(p: int) -> Column:
    """The first p letters of each word that has as many."""
    return F.transform(F.filter("words", lambda w: F.length(w) >= p), lambda w: F.concat(F.lit("p"), F.substring(w, 1, p)))


def lexicons(sample: DataFrame, size: int = LEXICON) -> list[dict[str, float]]:
    """Log-odds of words and word beginnings by document frequency: of fold 0, of fold 1, of both."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1)))
    starts = [_starts(p) for p in PREFIXES]
    keys = F.array_distinct(F.concat(F.transform("words", lambda w: F.concat(F.lit("w"), w)), *starts))
    rows = sample.select("y", "fold", words.alias("words")).select("y", "fold", F.explode(keys).alias("key"))
    count = lambda y, fold: F.count_if((F.col("y") == y) & (F.col("fold") == fold))
    table = rows.groupBy("key").agg(count(1, 0).alias("p0"), count(1, 1).alias("p1"), count(0, 0).alias("n0"), count(0, 1).alias("n1"))
    table = write_out(table.where(F.col("p0") + F.col("p1") >= 3), "word-counts")
    sizes = {(r["y"], r["fold"]): r["n"] for r in sample.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    out = []
    for folds in ((0,), (1,), (0, 1)):
        pos, neg = (sum(sizes.get((y, f), 0) for f in folds) + 1.0 for y in (1, 0))
        a, b = (sum((F.col(f"{c}{f}") for f in folds), F.lit(0)) for c in "pn")
        odds = F.log((a + 0.5) / pos) - F.log((b + 0.5) / neg)
        mean = (a + b) / (pos + neg)
        sure = (a / pos - b / neg) / F.sqrt(mean * (1 - mean) * (1 / pos + 1 / neg) + 1e-12)
        top = table.select("key", odds.alias("odds"), sure.alias("sure"), a.alias("a")).where((F.col("odds") > 1.0) & (F.col("sure") > 3.0) & (F.col("a") >= 3)).orderBy(F.desc("sure"), "key").limit(size)
        out.append({r["key"]: r["odds"] for r in top.collect()})
    return out


class ToxicityModel:
    """Lexicon, trees and calibration; plain data that a closure carries."""

    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees, calibration: Isotonic):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def table(self) -> WordTable:
        return WordTable(self.lexicon)

    def score(self, texts: pa.Array, table: WordTable) -> np.ndarray:
        return self.calibration(self.trees.raw(features(texts, table)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Learns from labelled rows for which `train` holds. Trees see features under the other fold's lexicon, calibration sees scores out of fold."""
    bound_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, train, max_labelled)
    first, second, both = lexicons(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in slices(batches, most=SMALL_SLICE):
            tables = tables or (WordTable(second), WordTable(first))
            fold = batch.column(1).to_numpy(zero_copy_only=False)
            texts = text_array(batch.column(2))
            x = np.where((fold == 0)[:, None], features(texts, tables[0]), features(texts, tables[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "fold", "x"])

    rows = sample.select("y", "fold", "text").mapInArrow(trimmed(run), "y int, fold int, x array<double>").collect()
    if not rows:
        return ToxicityModel({}, BoostedTrees(), Isotonic().fit(np.zeros(0), np.zeros(0)))
    x, y, fold = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float), np.array([r["fold"] for r in rows])
    order = np.lexsort((*x.T, y, fold))  # rows arrive in any order
    x, y, fold = x[order], y[order], fold[order]
    held = np.zeros(len(y))
    for f in (0, 1):
        if (fold == f).any():
            held[fold == f] = BoostedTrees().fit(x[fold != f], y[fold != f]).raw(x[fold == f])
    return ToxicityModel(both, BoostedTrees().fit(x, y), Isotonic().fit(held, y))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted beside their columns (or in place of columns of these names)."""
    bound_batches(docs.sparkSession)
    kept = docs.drop("score", "predicted")
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in slices(batches, text=at, most=SMALL_SLICE):
            table = table or model.table()
            score = model.score(text_array(batch.column(at)), table)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names, "a0", "a1"])

    return map_rows(kept, run, {"score": "double", "predicted": "int"})


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score `threshold` or more; columns of any name stay as they are."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in slices(batches, text=at, most=SMALL_SLICE):
            table = table or model.table()
            yield batch.filter(pa.array(model.score(text_array(batch.column(at)), table) < threshold))

    return map_rows(docs, run)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels, bucket("doc_id", 4) != 2)
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
