"""Near-duplicate documents by order MinHash, verified by banded alignment.

Words are lower-cased runs without ASCII white space. Each of a text's k-word runs (k = 3; a shorter text
is one run) is labelled with how often it occurred before, so repeats count. For each of `SKETCHES`
permutations the `2` least labelled runs are taken and kept in text order: two texts share a sketch more
likely the smaller their edit distance, order of passages included. Texts of up to `SHORT` words have too
few runs for that and are found exactly: of the longer of two similar texts, cut into one piece more than
the edits it may have, some piece is whole in the other, so each text has all its runs of the lengths of
such pieces as keys; texts a little longer have both. Texts that share a key are
compared by alignment of their words within a band that holds every alignment of similarity 0.8
(1 - edits / words of the longer text). Classes are the components of the links that pass; equal texts
are one text from the start, so groups of copies cost one row each.

Edge cases: null and empty texts are one class of equal texts; a null doc_id gets a null class and links
nothing; rows that repeat a doc_id are one document (each row is returned); ties take the least doc_id;
columns other than doc_id and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm._common import SMALL_SLICE, among, bound_batches, drop_out, hashes_of, mix, release, shingles, slices, text_array, trimmed, with_row_key, words_of, write_out
from siftline.llm._graph import first_tokens, linked_components, shared_buckets

WORDS = 3
SKETCHES = 48
SHORT = 64
SIMILARITY = 0.8
#: Bins of a text's word counts, a byte each.
BINS = 256
#: Pairs that are aligned at once in any case.
TURN = 20_000
#: Bits of a run's place beside its hash, and the greatest value.
PLACE = np.uint64((1 << 24) - 1)
END = np.uint64(0xFFFFFFFFFFFFFFFF)


def odd_numbers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def labelled_runs(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each run's hash together with the number of equal runs before it in its text."""
    if not len(values):
        return values
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    key = values ^ mix(text + np.uint64(1))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    occurrence = np.empty(len(values), np.uint64)
    occurrence[order] = (np.arange(len(values)) - np.repeat(fresh, np.diff(np.append(fresh, len(values))))).astype(np.uint64)
    return mix(values + occurrence * np.uint64(0x9E3779B97F4A7C15))


def order_sketches(values: np.ndarray, offsets: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """(texts x sketches) hashes of the two least labelled runs of each permutation in text order; texts without runs get 0."""
    n = np.diff(offsets)
    out = np.zeros((len(n), sketches), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    starts = offsets[:-1][full]
    place = (np.arange(len(values)) - np.repeat(offsets[:-1], n)).astype(np.uint64) & PLACE
    huge = np.flatnonzero(n[full] > int(PLACE))
    for j, odd in enumerate(odd_numbers(sketches)):
        v = ((values * odd) & ~PLACE) | place
        one = np.minimum.reduceat(v, starts)
        at_one = starts + (one & PLACE).astype(np.int64)
        v[at_one] = END
        two = np.minimum.reduceat(v, starts)
        at_two = np.where(two == END, at_one, starts + (two & PLACE).astype(np.int64))
        for i in huge:  # places need more bits than a packed minimum has
            v = (values[starts[i] : starts[i] + n[full[i]]] * odd) & ~PLACE
            at_one[i] = starts[i] + np.argmin(v)
            v[at_one[i] - starts[i]] = END
            at_two[i] = starts[i] + np.argmin(v)
        first, second = values[np.minimum(at_one, at_two)], values[np.maximum(at_one, at_two)]
        out[full, j] = mix(first * np.uint64(0x100000001B3) + mix(second + np.uint64(j + 1)))
    return out


def piece_lengths(n: int, least: float, most: int) -> set[int]:
    """Lengths of the pieces of texts of n to `most` words that can be similar to a text of n words."""
    edits = {m: int((1 - least) * m + 1e-9) for m in range(n, most + 1)}
    return {m // (e + 1) for m, e in edits.items() if m - n <= e}


def candidate_keys(words: np.ndarray, offsets: np.ndarray, sketches: int = SKETCHES, k: int = WORDS, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each text as (keys, offsets): sketches of texts of more than SHORT words, runs of the lengths of pieces of those that can be similar to a short one."""
    n = np.diff(offsets)
    most = int(SHORT / least + 1e-9)
    values, at = shingles(words, offsets, k)
    long = np.flatnonzero(n > SHORT)
    owners, keys = [np.repeat(long, sketches)], [order_sketches(labelled_runs(values, at), at, sketches)[long].ravel()]
    brief = np.flatnonzero((n > 0) & (n <= most))
    few, cut = words[np.repeat((n > 0) & (n <= most), n)], np.concatenate([[0], np.cumsum(n[brief])])
    lengths = {int(x): piece_lengths(int(x), least, most) for x in np.unique(n[brief])}
    for length in sorted(set().union(*lengths.values())):
        has = np.isin(n[brief], [x for x, found in lengths.items() if length in found])
        values, at = shingles(few, cut, length)
        owners.append(np.repeat(brief[has], np.diff(at)[has]))
        keys.append(mix(values[np.repeat(has, np.diff(at))] + np.uint64(length)))
    owner, key = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return key[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])


def edit_distance(a: list, b: list, most: int) -> int:
    """Edits between two word lists, or most + 1 if there are more: alignment within the band of +-most diagonals, a column of the band at a time as bits.

    Bit r of column j stands for the word j - most + r of a. The distance is followed down the band's lowest
    diagonal to the end of a, then along it.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a.pop()
        b.pop()
    n, m = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    if not n or not m or not most:
        return min(max(n, m), most + 1)
    match: dict = {}
    for i, w in enumerate(a):
        match[w] = match.get(w, 0) | (1 << (i + most))
    width = 2 * most + 1
    every, low = (1 << width) - 1, 1 << (width - 1)
    plus, minus = ((1 << (most + 1)) - 1) << most, 0
    distance, turn = min(n, most), max(0, n - most)
    last = 1 << (width - 2 if turn else n - 1 + most)
    for j, w in enumerate(b):
        eq = (match.get(w, 0) >> j) & every
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & every
        h_plus = (minus | ~(d0 | plus)) & every
        h_minus = d0 & plus
        if j < turn:
            distance += not d0 & low
        else:
            distance += bool(h_plus & last) - bool(h_minus & last)
            last >>= 1
        # each column that is left can lower the distance at the end of a by one at most
        if distance - (m - max(j + 1, turn)) > most:
            return most + 1
        d0 >>= 1
        plus = (h_minus | ~(d0 | h_plus)) & every
        minus = d0 & h_plus
    return min(distance, most + 1)


def similar(a: list, b: list, least: float) -> bool:
    """Whether 1 - edits / longest is at least `least`."""
    longest = max(len(a), len(b))
    most = int((1 - least) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    count: dict = {}
    for w in a:
        count[w] = count.get(w, 0) + 1
    common = 0
    for w in b:
        c = count.get(w, 0)
        if c:
            count[w] = c - 1
            common += 1
    return longest - common <= most and edit_distance(list(a), list(b), most) <= most


def lower_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    return words_of(pc.utf8_lower(texts))


def profiles_of(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts x BINS) counts of each text's words by hash, up to 255. An edit takes at most one from a bin and adds one to a bin, so counts bound the edits from below."""
    n = len(offsets) - 1
    at = np.repeat(np.arange(n), np.diff(offsets)) * BINS + (mix(words) % np.uint64(BINS)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=n * BINS), 255).astype(np.uint8).reshape(n, BINS)


def can_be_similar(a: np.ndarray, b: np.ndarray, longest: np.ndarray, least: float) -> np.ndarray:
    """Whether texts of these profiles, the longer of each two having `longest` words, may be similar: false only if they can't."""
    d = a.astype(np.int16) - b
    more, less = np.maximum(d, 0).sum(1), np.maximum(-d, 0).sum(1)
    return np.maximum(more, less) <= np.floor((1 - least) * longest + 1e-9)


def sketch_documents(docs: DataFrame, sketches: int = SKETCHES, k: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """doc_id, h1, h2 (128 bits of the whole text), size (words), profile (word counts), keys."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SMALL_SLICE):
            texts = text_array(batch.column(1))
            codes, offsets, distinct = lower_words(texts)
            words = hashes_of(distinct)[codes]
            keys, at = candidate_keys(words, offsets, sketches, k, least)
            counts = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(np.arange(batch.num_rows + 1, dtype=np.int32) * BINS), pa.py_buffer(profiles_of(words, offsets))])
            whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in texts.to_pylist()), ">i8").astype(np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(np.diff(offsets).astype(np.int32)), counts, lists], names=["doc_id", "h1", "h2", "size", "profile", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, h1 long, h2 long, size int, profile binary, keys array<long>")


def two_sides(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """The written pairs (a, b) with the columns of rows (id, ...) for both, as <name>_a and <name>_b; of rows, only those of a side's ids travel."""
    out = pairs
    for s in "ab":
        side = rows.select(F.col("id").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns])
        side = among(side, f"id_{s}", pairs.select(F.col(s).alias("of")), "of")
        out = out.join(side, F.col(s) == F.col(f"id_{s}"))
    return out.select("a", "b", *[f"{c}_{s}" for c in columns for s in "ab"])


def close_pairs(pairs: DataFrame, profiles: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of ids whose word counts (id, size, profile) allow them to be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            a, b = (np.frombuffer(b"".join(column(f"profile_{s}").to_pylist()), np.uint8).reshape(-1, BINS) for s in "ab")
            longest = np.maximum(*(column(f"size_{s}").to_numpy() for s in "ab"))
            yield batch.select(["a", "b"]).filter(pa.array(can_be_similar(a, b, longest, least)))

    return two_sides(pairs, profiles, "size", "profile").mapInArrow(trimmed(run), "a long, b long")


def align_pairs(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY, made: list | None = None) -> DataFrame:
    """The written pairs (a, b) of ids whose texts (id, text) are similar by alignment; made gets the tables that the result reads.

    Each pair moves two texts. So that a group of near copies, in which a text has many pairs, does not move many
    times the texts at once, more than about one pair a text are aligned in turns, and what a turn has moved goes before the next.
    """
    turns = math.ceil(pairs.count() / max(TURN, texts.count()))
    if turns < 2:
        return _aligned(pairs, texts, least)
    turn = F.pmod(F.xxhash64("a", "b"), F.lit(turns))
    out = []
    for t in range(turns):
        part = write_out(pairs.where(turn == t), "near-turn")
        out.append(write_out(_aligned(part, texts, least), "near-aligned"))
        drop_out(pairs.sparkSession, part)
        release(pairs.sparkSession)
    if made is not None:
        made.extend(out)
    return functools.reduce(DataFrame.union, out)


def _aligned(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    rows = two_sides(pairs, texts, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a", SMALL_SLICE):
            sides = []
            for name in ("text_a", "text_b"):
                codes, offsets, distinct = lower_words(text_array(batch.column(batch.schema.get_field_index(name))))
                words = hashes_of(distinct)[codes].tolist()
                sides.append([words[x:y] for x, y in zip(offsets, offsets[1:], strict=False)])
            keep = [similar(x, y, least) for x, y in zip(*sides, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return rows.mapInArrow(trimmed(run), "a long, b long").distinct()


def pair_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of neighbouring words of texts, the nth occurrence of a pair being a token of its own."""
    codes, offsets, distinct = lower_words(texts)
    values, at = shingles(hashes_of(distinct)[codes], offsets, 2)
    return labelled_runs(values, at), at


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, sketches: int = SKETCHES) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class, for every row of docs."""
    spark = docs.sparkSession
    marked = write_out(sketch_documents(docs, sketches, least=least), "order-sketches")
    first = write_out(marked.groupBy("h1", "h2").agg(F.min("doc_id").alias("first")).where("first IS NOT NULL"), "distinct-texts")
    one = (marked.h1 == first.h1) & (marked.h2 == first.h2) & (marked.doc_id == first["first"])
    keyed = write_out(marked.where("size > 0").join(first, one, "left_semi").select(F.col("doc_id").alias("id"), "size", "keys").distinct(), "near-keys")
    buckets = shared_buckets(keyed.select("id", "size", F.explode("keys").alias("key")), "near")
    wanted = write_out(buckets.select(F.col("id").alias("wanted")).distinct(), "near-wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = write_out(among(texts, "id", wanted, "wanted"), "near-texts")
    # an edit changes two pairs of neighbours at most, so of n pairs (n + 1 words) 2 * edits may be missing
    spare = lambda n: 2 * np.floor((1 - least) * (n + 1) + 1e-9)
    need = lambda n, m: F.greatest(n, m) - 2 * F.floor((1 - least) * (F.greatest(n, m) + 1) + 1e-9)
    profiles = marked.select(F.col("doc_id").alias("id"), "size", "profile").where("id IS NOT NULL")
    close = []

    def verify(pairs: DataFrame) -> DataFrame:
        # word counts rule most chance candidates out, so that few texts travel
        close.append(write_out(close_pairs(pairs, profiles, least), "near-close"))
        return align_pairs(close[-1], texts, least, close)

    roots = linked_components(buckets, verify, lambda members: first_tokens(among(texts, "id", members.withColumnRenamed("id", "member"), "member", "inner"), pair_tokens, spare), "near", least, need)
    drop_out(spark, keyed, buckets, wanted, texts, *close)
    same = marked.select("doc_id", "h1", "h2").join(first.withColumnsRenamed({"h1": "g1", "h2": "g2"}), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left").select("doc_id", "first")
    out = same.join(roots.withColumnRenamed("id", "known"), F.col("first") == F.col("known"), "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "first")).alias("class_id"))


def keep_one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class of near-duplicates stays: that with the least doc_id, then the least hash of its text; a row without doc_id only if its class has no other.

    Each row is decided by its own text: rows that repeat a doc_id with another text, and rows without one, are
    members of their own. Rows equal in doc_id and text are one row; of their other columns, those with the least
    hash stay. Columns of any name are kept.
    """
    keyed, key = with_row_key(docs)
    classes = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), least).select(F.col("doc_id").alias("member"), "class_id").distinct()
    ids = keyed.select(F.col(key).alias("row"), F.col("doc_id").alias("id")).distinct()
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    best = classes.join(ids, F.col("member") == F.col("row")).groupBy("class_id").agg(F.min(order).alias("best"))
    keep = write_out(best.select(F.col("best.row").alias("kept")), "kept-rows")
    again = write_out(keyed.groupBy(F.col(key).alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"), "repeated-rows")
    kept = among(keyed, key, keep, "kept")
    single = among(kept, key, again, "again", "left_anti").drop(key)
    if again.isEmpty():
        return single
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = among(kept, key, again, "again").groupBy(key).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("whole"))
    return single.union(one.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns]))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
