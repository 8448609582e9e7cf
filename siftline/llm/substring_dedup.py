"""Substring dedup: paragraph MinHash banding, exact Jaccard verification, components.

Words are lower-cased runs without ASCII white space. Paragraphs are lines of at least `MIN_WORDS`
words (shorter ones are the line operator's). A paragraph's signature has `BANDS` bands of `ROWS` minima
over its five-word shingles; 10 bands of 4 find a pair of similarity 0.8 with probability 0.995.
Paragraphs that share a band are compared by the exact Jaccard similarity of their shingles (0.8 or
more), and the components of those links are classes.

A passage may repeat inside paragraphs that differ otherwise. Each window of `WINDOW` consecutive
`RUN`-word runs of a text, across lines, is a paragraph of its own with a one-row signature: its minimum
run hash. Two texts that share RUN + WINDOW - 1 (50) words in a row share a window and so its minimum;
equal minima are equal runs. A stretch that documents share begins and ends less than a window from a
minimum in it, so around minima found in more than one document every run is looked up: those found in
more than one document are classes, and together they cover such a stretch to its last word.

Of each class the occurrence with the least (doc_id, first_word) stays. Results are spans of words.

Edge cases: null and empty texts hold nothing; rows without doc_id take no part; rows that repeat a
doc_id are one document and repeat no passage; passages that occur only inside one document are left;
ties keep the least doc_id; columns other than doc_id and text are ignored; empty tables stay empty.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm._common import SMALL_SLICE, among, bound_batches, drop_out, hashes_of, minimum_of, mix, release, shingles, slices, text_array, trimmed, words_of, write_out
from siftline.llm._graph import first_tokens, linked_components, shared_buckets
from siftline.llm.near_dup import odd_numbers
from siftline.llm.quality_crf import line_bounds

MIN_WORDS = 20
BANDS = 10
ROWS = 4
RUN = 20
WINDOW = 31
#: Runs of words that are looked up at once.
RUNS_AT_ONCE = 8_000_000
SIMILARITY = 0.8


def band_keys(values: np.ndarray, offsets: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(paragraphs x bands) keys of minima; paragraphs without shingles get equal keys and must be left out."""
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    for j, odd in enumerate(odd_numbers(bands * rows)):
        least = minimum_of(values * odd, offsets, 0)
        out[:, j // rows] = mix(out[:, j // rows] * np.uint64(0x100000001B3) + least + np.uint64(j))
    return out


def run_hashes(words: np.ndarray, run: int = RUN) -> np.ndarray:
    """Hash of the `run` words from each word on (a polynomial, from prefix sums), for all but the last run - 1 words."""
    if len(words) < run:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    powers = np.full(len(words), base, np.uint64)
    powers[0] = 1
    back = np.full(len(words), inverse, np.uint64)
    back[0] = 1
    with np.errstate(over="ignore"):
        powers, back = np.cumprod(powers), np.cumprod(back)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * powers)])
        return mix((total[run:] - total[:-run]) * back[: len(words) - run + 1])


def window_minima(values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the minimum (the last among equals) of every window of consecutive values; fewer values are one window."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    window = min(window, n)
    # minima of windows of doubling length, each with its last position
    at = np.arange(n)
    least, place, size = values.copy(), at.copy(), 1
    while size < window:
        step = min(size, window - size)
        a, b = least[:-step] if step else least, least[step:]
        pa_, pb = place[:-step], place[step:]
        right = b <= a
        least, place = np.where(right, b, a), np.where(right, pb, pa_)
        size += step
    return np.unique(place)


def parts_of(docs: DataFrame, min_words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, kind (0 paragraph, 1 run), first_word, n_words, id (hash of the words), n_shingles (different ones) and keys of paragraphs."""
    bound_batches(docs.sparkSession)
    schema = "doc_id long, kind int, first_word int, n_words int, id long, n_shingles int, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SMALL_SLICE):
            texts = pc.utf8_lower(text_array(batch.column(1)))
            data, starts, _, of_text = line_bounds(texts)
            edge = np.append(starts, len(data)).astype(np.int64)
            lines = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edge.tobytes()), pa.py_buffer(data.tobytes()))
            codes, at, distinct = words_of(lines)
            words = hashes_of(distinct)[codes]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            n = np.diff(at)
            text = np.repeat(np.arange(len(texts)), np.diff(of_text))
            first = at[:-1] - at[of_text[:-1]][text]
            long = np.flatnonzero(n >= min_words)
            values, offsets = shingles(words, at)
            hashes = run_hashes_by(words, at)
            keep = np.repeat(np.isin(np.arange(len(n)), long), np.diff(offsets))
            cut = np.concatenate([[0], np.cumsum(np.diff(offsets)[long])])
            keys = band_keys(values[keep], cut, bands, rows).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
            different = distinct_of(values[keep], cut)
            yield pa.RecordBatch.from_arrays([pa.array(ids[text[long]], pa.int64()), pa.array(np.zeros(len(long), np.int32)), pa.array(first[long], pa.int32()), pa.array(n[long], pa.int32()), pa.array(hashes[long].view(np.int64)), pa.array(different, pa.int32()), lists], names=["doc_id", "kind", "first_word", "n_words", "id", "n_shingles", "keys"])
            found = [(t, window_minima(r), r) for t, (a, b) in enumerate(zip(at[of_text[:-1]], at[of_text[1:]], strict=True)) if len(r := run_hashes(words[a:b]))]
            if found:
                who = np.repeat([t for t, _, _ in found], [len(p) for _, p, _ in found])
                where = np.concatenate([p for _, p, _ in found])
                what = np.concatenate([r[p] for _, p, r in found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[who], pa.int64()), pa.array(np.ones(len(who), np.int32)), pa.array(where, pa.int32()), pa.array(np.full(len(who), RUN, np.int32)), pa.array(what), pa.nulls(len(who), pa.int32()), pa.nulls(len(who), pa.list_(pa.int64()))], names=["doc_id", "kind", "first_word", "n_words", "id", "n_shingles", "keys"])

    rows_ = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_.mapInArrow(trimmed(run), schema)


def distinct_of(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many different values each run has."""
    run = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    if not len(values):
        return np.zeros(len(offsets) - 1, np.int64)
    key = values ^ mix(run + np.uint64(1))
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = order[np.concatenate([[True], key[1:] != key[:-1]])]
    return np.bincount(run[fresh].astype(np.int64), minlength=len(offsets) - 1)


def run_hashes_by(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash of all words of each line, in order."""
    place = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
    each = mix(words + mix(place.astype(np.uint64) + np.uint64(1)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))


def similar_paragraphs(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose five-word shingle sets have a Jaccard similarity of at least `least`."""
    left = texts.select(F.col("id").alias("ida"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("idb"), F.col("text").alias("text_b"))
    rows = pairs.join(left, F.col("a") == F.col("ida")).join(right, F.col("b") == F.col("idb")).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a", SMALL_SLICE):
            sides = []
            for name in ("text_a", "text_b"):
                codes, offsets, distinct = words_of(text_array(batch.column(batch.schema.get_field_index(name))))
                values, cut = shingles(hashes_of(distinct)[codes], offsets)
                values = values.tolist()
                sides.append([set(values[x:y]) for x, y in zip(cut, cut[1:], strict=False)])
            keep = []
            for x, y in zip(*sides, strict=True):
                common = len(x & y)
                keep.append(common >= least * (len(x) + len(y) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(trimmed(run), "a long, b long")


def shingle_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The five-word shingles of paragraphs."""
    codes, offsets, distinct = words_of(texts)
    return shingles(hashes_of(distinct)[codes], offsets)


def paragraph_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and text (words, lower-cased, one space between) of the spans (id, at_doc, first_word, n_words)."""
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = wanted.groupBy("at_doc").agg(F.collect_list(F.struct("id", "first_word", "n_words")).alias("spans"))
    rows = texts.join(asked, F.col("doc_id") == F.col("at_doc")).select("spans", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SMALL_SLICE):
            texts = pc.utf8_lower(text_array(batch.column(1))).to_pylist()
            ids, out = [], []
            for spans, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                words = pc.ascii_split_whitespace(pa.array([text])).to_pylist()[0]
                words = [w for w in words if w]
                for s in spans:
                    ids.append(s["id"])
                    out.append(" ".join(words[s["first_word"] : s["first_word"] + s["n_words"]]))
            # another row of the doc_id has other words at the place: only those with the id's hash are the paragraph
            codes, at, distinct = words_of(pa.array(out, pa.large_string()))
            own = pa.array(run_hashes_by(hashes_of(distinct)[codes], at).view(np.int64) == np.array(ids, np.int64), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["id", "text"]).filter(own)

    return rows.mapInArrow(trimmed(run), "id long, text string")


def runs_around(docs: DataFrame, hits: DataFrame, reach: int = WINDOW - 1) -> DataFrame:
    """doc_id, first_word, id (hash of the words), fresh (first of its kind in the text) of all runs that start at most `reach` words from a hit (at_doc, first_word)."""
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = hits.groupBy("at_doc").agg(F.collect_set("first_word").alias("starts"))
    rows = texts.join(asked, F.col("doc_id") == F.col("at_doc")).select("doc_id", "starts", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SMALL_SLICE):
            codes, at, distinct = words_of(pc.utf8_lower(text_array(batch.column(2))))
            words = hashes_of(distinct)[codes]
            starts = batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                hashes = run_hashes(words[at[i] : at[i + 1]])
                hit = starts[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                edges = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(edges, np.clip(hit - reach, 0, len(hashes)), 1)
                np.add.at(edges, np.clip(hit + reach + 1, 0, len(hashes)), -1)
                near = np.flatnonzero(np.cumsum(edges[:-1]))
                fresh = np.zeros(len(near), bool)
                fresh[np.unique(hashes[near], return_index=True)[1]] = True
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), doc, np.int64)), pa.array(near, pa.int32()), pa.array(hashes[near].view(np.int64)), pa.array(fresh)], names=["doc_id", "first_word", "id", "fresh"])

    return rows.mapInArrow(trimmed(run), "doc_id long, first_word int, id long, fresh boolean")


def repeated_runs(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, first_word, n_words, class_doc_id, kept of the runs around hits that lie in more than one document, those of one class_doc_id merged."""
    spark = docs.sparkSession
    runs = write_out(runs_around(docs, hits), "runs")
    release(spark)
    # equal runs are looked up in one part, and what a part has shuffled goes before the next
    parts = 1 + runs.count() // RUNS_AT_ONCE
    found = []
    for part in range(parts):
        some = runs.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        shared = some.groupBy(F.col("id").alias("c")).agg(F.min("doc_id").alias("class_doc_id"), F.max("doc_id").alias("last_doc")).where("class_doc_id < last_doc").drop("last_doc")
        shared = write_out(shared, "shared-runs")
        marked = among(some, "id", shared, "c", "inner").select("doc_id", "first_word", F.lit(RUN).alias("n_words"), "class_doc_id", (F.col("fresh") & (F.col("doc_id") == F.col("class_doc_id"))).alias("kept"))
        found.append(write_out(marked, "marked-runs"))
        drop_out(spark, shared)
        release(spark)
    drop_out(spark, runs)
    marked = functools.reduce(DataFrame.union, found)
    out = write_out(merged(marked).select(*marked.columns), "run-spans")
    drop_out(spark, *found)
    release(spark)
    return out


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of one document, kept and class_doc_id as one."""
    by = ["doc_id", "kept", "class_doc_id"]
    order = Window.partitionBy(*by).orderBy("first_word", "n_words")
    reach = F.max(F.col("first_word") + F.col("n_words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("reach", reach).withColumn("island", F.sum(F.when(F.col("reach") >= F.col("first_word"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy(*by, "island").agg(F.min("first_word").alias("first_word"), F.max(F.col("first_word") + F.col("n_words")).alias("end"))
    return whole.withColumn("n_words", F.col("end") - F.col("first_word"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, bands: int = BANDS, rows: int = ROWS, least: float = SIMILARITY) -> DataFrame:
    """doc_id, first_word, n_words, class_doc_id, kept: passages whose class lies in more than one document, overlapping spans of one class_doc_id merged."""
    spark = docs.sparkSession
    parts = write_out(parts_of(docs, min_words, bands, rows), "passages")
    paragraphs = parts.where("kind = 0")
    buckets = shared_buckets(paragraphs.select("id", F.col("n_shingles").alias("size"), F.explode("keys").alias("key")), "passage")
    wanted = write_out(buckets.select(F.col("id").alias("wanted")).distinct(), "passage-wanted")
    one = among(paragraphs, "id", wanted, "wanted").groupBy("id").agg(F.min("doc_id").alias("at_doc"), F.min_by("first_word", "doc_id").alias("first_word"), F.min("n_words").alias("n_words"))
    texts = write_out(paragraph_texts(docs, one).groupBy("id").agg(F.first("text").alias("text")), "passage-texts")
    roots = linked_components(buckets, lambda pairs: similar_paragraphs(pairs, texts, least), lambda members: first_tokens(texts.join(members, "id"), shingle_tokens, lambda n: np.floor((1 - least) * n + 1e-9)), "passages", least)
    drop_out(spark, buckets, wanted, texts)
    release(spark)
    spots = parts.select("kind", "doc_id", "first_word", "n_words", "id")
    named = spots.where("kind = 0").join(roots.withColumnRenamed("id", "known"), F.col("id") == F.col("known"), "left").select("kind", "doc_id", "first_word", "n_words", F.coalesce("root", "id").alias("class"))
    named = write_out(named.union(spots.where("kind = 1")), "named-passages")
    drop_out(spark, parts, roots)
    shared = named.groupBy(F.col("kind").alias("k"), F.col("class").alias("c")).agg(F.min("doc_id").alias("class_doc_id"), F.max("doc_id").alias("last_doc")).where("class_doc_id < last_doc").drop("last_doc")
    shared = write_out(shared, "shared-classes")
    some = among(named, "class", shared, "c", "inner").where("kind = k").select("kind", "class", "doc_id", "first_word", "n_words", "class_doc_id")
    some = write_out(some, "shared-passages")
    drop_out(spark, named, shared)
    release(spark)
    lines = some.where("kind = 0")
    first = lines.where("doc_id = class_doc_id").groupBy(F.col("class").alias("c")).agg(F.min("first_word").alias("class_word"))
    marked = lines.join(first, F.col("class") == F.col("c")).select("doc_id", "first_word", "n_words", "class_doc_id", ((F.col("doc_id") == F.col("class_doc_id")) & (F.col("first_word") == F.col("class_word"))).alias("kept"))
    marked = marked.union(repeated_runs(docs, some.where("kind = 1").select(F.col("doc_id").alias("at_doc"), "first_word")))
    return merged(marked).select("doc_id", "first_word", "n_words", "class_doc_id", "kept")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
