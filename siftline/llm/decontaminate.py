"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming blocks, exact verification.

Words are lower-cased runs of letters, digits and marks of them. For every distinct item length (in
words) a window of that length moves over each text; its 64-bit fingerprint is the sign of the summed
+-weights of its five-word shingles' bits. An index splits fingerprints into 8 blocks: two within
radius r agree in some block to within r // 8 bits, so probing all block values that near finds every
item within the radius. Found items are verified by the exact weighted Jaccard similarity of shingle
multisets (weight: a shingle's occurrences times its letters) at 0.8.

A window is fingerprinted only where at least 0.8 / 1.8 of the two sides' total shingle weight could be
shared: windows short of item shingles cannot reach 0.8 and are passed over, which loses nothing. Items
go to the workers in blocks of bounded size; more items mean more scans, never fewer comparisons.

Edge cases: null and empty texts hold nothing; items that are null or have no word are left out; items
under five words are one shingle and match runs of exactly their words; repeated items report the least
item_id of equal texts; of windows equally similar to an item the first is reported; very long texts are
searched whole; a null doc_id is reported as null; repeated rows repeat their result; columns other than the
ids and texts are kept (`drop_contaminated`, under any name) or ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm._common import SMALL_SLICE, among, bound_batches, hashes_of, mix, slices, text_array, trimmed, with_row_key, words_of, write_out

WORDS = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 8
#: Items sent to the workers at once; also bounds what a closure carries (about 0.5 KB of shingles and 2.5 KB of index entries an item).
ITEMS = 10_000


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    return words_of(pc.replace_substring_regex(pc.utf8_lower(texts), pattern=r"[^\pL\pN\pM]+", replacement=" "))


def runs(hashes: np.ndarray, letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and letters of the k-word run that starts at each word but the last k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value, weight = np.full(n, k, np.uint64), np.zeros(n, np.int64)
    for j in range(k):
        value = mix(value * np.uint64(0x100000001B3) + hashes[j : j + n])
        weight = weight + letters[j : j + n]
    return value, weight


def signs(values: np.ndarray) -> np.ndarray:
    """(values x 64) of +1 and -1."""
    bits = np.unpackbits(mix(values).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprint(total: np.ndarray) -> np.ndarray:
    return np.packbits(total > 0, axis=1)


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of smaller over sum of larger weights, over all shingles of both sides; equal shingles of a side add up."""
    keys, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = np.bincount(inverse[: len(a)], wa, len(keys)), np.bincount(inverse[len(a) :], wb, len(keys))
    return float(np.minimum(left, right).sum() / max(np.maximum(left, right).sum(), 1e-9))


class ItemIndex:
    """Fingerprints of the items by length, in blocks of 8 bits."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.items: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        codes, offsets, distinct = plain_words(pa.array(texts, pa.large_string()))
        hashes, letters = hashes_of(distinct)[codes], np.array([len(w) for w in distinct.to_pylist()], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        for i, a, b in zip(ids, offsets, offsets[1:], strict=False):
            if b > a:
                k = min(WORDS, int(b - a))
                self.items.setdefault(int(b - a), []).append((i, *runs(hashes[a:b], letters[a:b], k)))
        self.known = {k: np.unique(np.concatenate([v for n, group in self.items.items() if min(n, WORDS) == k for _, v, _ in group] or [np.zeros(0, np.uint64)])) for k in range(1, WORDS + 1)}
        self.least_weight = {n: min(int(w.sum()) for _, _, w in group) for n, group in self.items.items()}
        self.marks = {n: np.stack([fingerprint((signs(v) * w[:, None]).sum(axis=0, keepdims=True))[0] for _, v, w in group]) for n, group in self.items.items()}
        near = np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(8), r)], np.uint8)
        self.blocks: dict[int, list[dict[int, np.ndarray]]] = {}
        for n, marks in self.marks.items():
            tables = []
            for block in range(BLOCKS):
                table: dict[int, list[int]] = {}
                for at, value in enumerate(marks[:, block]):
                    for probe in near ^ value:
                        table.setdefault(int(probe), []).append(at)
                tables.append({v: np.array(rows) for v, rows in table.items()})
            self.blocks[n] = tables

    def within(self, n: int, mark: np.ndarray) -> np.ndarray:
        """Numbers of all items of n words whose fingerprint differs from mark in at most RADIUS bits."""
        found = [t[v] for t, v in zip(self.blocks[n], mark.tolist(), strict=True) if v in t]
        if not found:
            return np.zeros(0, np.int64)
        rows = np.unique(np.concatenate(found))
        return rows[np.bitwise_count(self.marks[n][rows] ^ mark).sum(axis=1) <= RADIUS]

    def search(self, hashes: np.ndarray, letters: np.ndarray, masks: dict[int, tuple]) -> list[tuple[int, int, int, float]]:
        """(item_id, first word, words, similarity) of the best window for each item in one text."""
        best: dict[int, tuple[float, int, int]] = {}
        for n, group in self.items.items():
            k = min(n, WORDS)
            values, weight, shared = masks[k]
            span = n - k + 1
            if len(values) < span or not shared.any():
                continue
            total = np.concatenate([[0], np.cumsum(weight)])
            common = np.concatenate([[0], np.cumsum(weight * shared)])
            whole, some = total[span:] - total[:-span], common[span:] - common[:-span]
            # similarity <= shared / (window + item - shared), so shared >= s / (1 + s) of the sum
            hits = np.flatnonzero((some > 0) & (some >= SIMILARITY / (1 + SIMILARITY) * (whole + self.least_weight[n]) - 1e-6))
            if not len(hits):
                continue
            for part in np.split(hits, np.flatnonzero(np.diff(hits) > span) + 1):
                a, b = int(part[0]), int(part[-1]) + span
                sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(signs(values[a:b]) * weight[a:b, None], axis=0)])
                marks = fingerprint(sums[part - a + span] - sums[part - a])
                for at, mark in zip(part.tolist(), marks, strict=True):
                    for row in self.within(n, mark):
                        item, v, w = group[row]
                        s = weighted_jaccard(values[at : at + span], weight[at : at + span], v, w)
                        if s >= SIMILARITY - 1e-9 and (item not in best or s > best[item][0]):
                            best[item] = (s, at, n)
        return [(item, at, n, s) for item, (s, at, n) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, size: int = ITEMS) -> Iterator[ItemIndex]:
    """Indexes over consecutive blocks of distinct items, each of at most `size`."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL").groupBy("text").agg(F.min("item_id").alias("item_id"))
    count = items.count()
    blocks = -(-count // size)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        yield ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: the best window of each document for each item it holds."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, first_word int, n_words int, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    for number, index in enumerate(item_blocks(benchmark)):
        found = rows.mapInArrow(trimmed(_searcher(index)), schema)
        out = found if not number else out.union(found)
    return out


def _searcher(index: ItemIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SMALL_SLICE):
            codes, offsets, distinct = plain_words(text_array(batch.column(1)))
            hashes = hashes_of(distinct)[codes]
            sizes = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
            ids = batch.column(0).to_pylist()
            touched: set[int] = set()
            flat: dict[int, tuple] = {}
            for k, known in index.known.items():
                if len(known):
                    values, weight = runs(hashes, sizes, k)
                    shared = np.zeros(len(values), bool)
                    if len(values):
                        few = np.zeros(1 << 16, bool)
                        few[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
                        maybe = np.flatnonzero(few[(values & np.uint64(0xFFFF)).astype(np.int64)])
                        shared[maybe] = np.isin(values[maybe], known)
                    flat[k] = (values, weight, shared)
                    touched.update((np.searchsorted(offsets, np.flatnonzero(shared), side="right") - 1).tolist())
            out = []
            for t in sorted(touched):
                a, b = int(offsets[t]), int(offsets[t + 1])
                masks = {k: tuple(x[a : max(a, b - k + 1)] for x in parts) for k, parts in flat.items()}
                out += [(ids[t], *found) for found in index.search(hashes[a:b], sizes[a:b], masks)]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.float64())], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item; each row is decided by its own text, rows without or with a repeated doc_id too. Columns of any name stay."""
    keyed, key = with_row_key(docs)
    bad = contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("bad")).distinct()
    return among(keyed, key, write_out(bad, "contaminated"), "bad", "left_anti").drop(key)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark)
