"""Collocations: frequent phrases scored by their weakest cut, level by level.

Level 1 counts words; level k reads the texts again and emits a k-gram only where both (k-1)-grams in it were
frequent (Apriori). What is frequent travels to the readers as a bitmap of hashes of at most BITS bits, whatever the
input: a false hit of the bitmap only lets a k-gram through that is then counted and dropped. Levels from 2 on are
counted by 64-bit hashes first; hashes that reach the least count are never fewer than the phrases that do, so the
phrases behind them are then read and counted as texts, exactly. Cuts look up both parts in the tables of the lower
levels; products are exact decimals of 38 digits (exact for counts below 4 * 10^15).

Edge cases: a null or empty text has no words; a null group is `und`; words are between blanks and tabs inside
pieces, and no phrase crosses a piece's end; very long texts are slices of their own; repeated rows count again; other
columns are ignored, whatever their names; ties of score are ordered by count, then by the bytes of the phrase; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm._common import SMALL_SLICE, bound_batches, hashes_of, mix, slices, text_array, trimmed, write_out

#: Greatest size of a bitmap: 16 MB in each reader, and at most 33 MB of its filled words in the driver.
BITS = 1 << 27
#: Parts of a group that choose their best phrases before the group does.
SALTS = 8

_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words of a slice in order: codes, distinct words, the text of each and the piece of each."""

    def __init__(self, texts: pa.LargeStringArray):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        data, offsets = _LOWER[data], offsets - offsets[0]
        kind = _CLASS[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        inside = kind == 0
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        start = np.flatnonzero(inside & (~before | first[:-1]))
        size = np.add.reduceat(inside, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        kept = np.ascontiguousarray(data[inside])
        flat = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept)])
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = coded.dictionary
        self.text = np.searchsorted(offsets, start, side="right") - 1
        # a break before a word: a piece's end or another text since the word before
        breaks = np.cumsum(kind == 2)[start] if len(start) else start
        self.piece = breaks + self.text


def gram_hashes(hashes: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the group and the k words from each place on; places at the end have no meaning."""
    value = group
    for j in range(k):
        word = np.concatenate([hashes[j:], np.zeros(min(j, len(hashes)), np.uint64)])
        value = mix(value * np.uint64(0x100000001B3) + word)
    return value


def slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(36)) & mask


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    out = np.ones(len(hashes), bool)
    for slot in slots(hashes, 64 * len(bitmap)):
        out &= (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return out


def make_bitmap(hashes: DataFrame, most: int = BITS) -> np.ndarray:
    """Two bits for each row of the long column `h`: 16 bits a row, a power of two, at most `most` bits."""
    spark = hashes.sparkSession
    bits = 1 << 16
    rows = hashes.count()
    while bits < 16 * rows and bits < most:
        bits *= 2
    slot = F.explode(F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 36).bitwiseAND(bits - 1)))
    filled = hashes.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("word")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[filled.column("at").to_numpy()] = filled.column("word").to_numpy().view(np.uint64)
    return bitmap


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of one of each, and how often each occurs."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else order
    return ranked[begin], order[begin], np.diff(np.append(begin, len(keys)))


def _read(docs: DataFrame, schema: str, make) -> DataFrame:
    """make(words, codes of groups, names of groups, hashes of the distinct words, seeds of the words by group) over slices of docs (g, text); gives record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SMALL_SLICE):
            words = Words(text_array(batch.column(1)))
            named = batch.column(0).cast(pa.string()).dictionary_encode()
            of = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.text]
            seeds = hashes_of(named.dictionary)
            yield from make(words, of, named.dictionary, hashes_of(words.distinct)[words.codes], seeds[of] if len(of) else np.zeros(0, np.uint64))

    return docs.mapInArrow(trimmed(run), schema)


def _same_piece(words: Words, k: int) -> np.ndarray:
    """Places whose k words stand in one piece."""
    n = len(words.piece)
    out = np.zeros(n, bool)
    if n >= k:
        out[: n - k + 1] = words.piece[: n - k + 1] == words.piece[k - 1 :]
    return out


def _words(docs: DataFrame) -> DataFrame:
    """g, phrase, h, f: words, exactly."""

    def make(words, of, names, hashes, seeds):
        _, at, f = _counted(of * max(1, len(words.distinct)) + words.codes)
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(of[at])), words.distinct.take(pa.array(words.codes[at])).cast(pa.string()), pa.array(gram_hashes(hashes, seeds, 1)[at].view(np.int64)), pa.array(f)], names=["g", "phrase", "h", "f"]
        )

    return _read(docs, "g string, phrase string, h bigint, f bigint", make).groupBy("g", "phrase", "h").agg(F.sum("f").alias("f"))


def _hashes(docs: DataFrame, k: int, shorter) -> DataFrame:
    """h, f: k-grams both of whose (k-1)-grams are in the broadcast bitmap, by hash."""

    def make(words, of, names, hashes, seeds):
        known = in_bitmap(shorter.value, gram_hashes(hashes, seeds, k - 1))
        ok = _same_piece(words, k) & known & np.concatenate([known[1:], [False]])[: len(known)]
        h, _, f = _counted(gram_hashes(hashes, seeds, k)[ok])
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f)], names=["h", "f"])

    return _read(docs, "h bigint, f bigint", make).groupBy("h").agg(F.sum("f").alias("f"))


def _phrases(docs: DataFrame, levels: dict) -> DataFrame:
    """g, phrase, words, f: k-grams whose hashes are in the broadcast bitmap of their level, exactly."""

    def make(words, of, names, hashes, seeds):
        for k, bitmap in levels.items():
            value = gram_hashes(hashes, seeds, k)
            here = np.flatnonzero(_same_piece(words, k) & in_bitmap(bitmap.value, value))
            # one place for each hash of the slice; 64 bits tell the grams of a slice apart only nearly always, so places are compared
            _, first, group = np.unique(value[here], return_index=True, return_inverse=True)
            one = here[first][group]
            same = np.ones(len(here), bool)
            for j in range(k):
                same &= words.codes[here + j] == words.codes[one + j]
            same &= of[here] == of[one]
            at = np.concatenate([here[first], here[~same]])
            f = np.concatenate([np.bincount(group[same], minlength=len(first)), np.ones((~same).sum(), np.int64)])
            parts = [words.distinct.take(pa.array(words.codes[at + j])).cast(pa.string()) for j in range(k)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of[at])), pc.binary_join_element_wise(*parts, " "), pa.array(np.full(len(at), k, np.int32)), pa.array(f)], names=["g", "phrase", "words", "f"])

    return _read(docs, "g string, phrase string, words int, f bigint", make).groupBy("g", "phrase", "words").agg(F.sum("f").alias("f"))


def _scored(levels: DataFrame, longest: int, share: int) -> DataFrame:
    """Candidates with their weakest cut, without those that a longer candidate mostly holds."""
    words = F.split("phrase", " ")
    many = levels.where("words > 1").withColumn("w", words)
    cuts = many.select("g", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "w")
    cuts = cuts.select("g", "phrase", "words", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words")), " ").alias("right"))
    part = lambda name, f: levels.select(F.col("g"), F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["g", "left"]).join(part("right", "r"), ["g", "right"])
    cuts = cuts.withColumn("score", F.expr("(1000000BD * cast(a as decimal(16, 0)) * cast(a as decimal(16, 0))) div (cast(l as decimal(16, 0)) * cast(r as decimal(16, 0)))"))
    best = cuts.groupBy("g", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    longer = many.where("words > 2").select("g", "words", F.col("f").alias("whole"), "w")
    part_of = lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice("w", i, F.lit(k)), " "))
    inside = [longer.where(F.col("words") > k).select("g", "whole", F.explode(part_of(k)).alias("phrase")) for k in range(2, longest)]
    kept = best
    if inside:
        held = reduce(DataFrame.unionByName, inside).groupBy("g", "phrase").agg(F.max("whole").alias("whole"))
        kept = best.join(held, ["g", "phrase"], "left").where(~F.coalesce(100 * F.col("whole") >= share * F.col("a"), F.lit(False)))
    return kept.select("g", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score"))


def mine_phrases(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, share: int = 50, text: str = "text", group: str = "lang", most_bits: int = BITS) -> DataFrame:
    """The `top` phrases of 2 to `longest` words of each group: group, rank, phrase, a, l, r, n, score.

    a, l and r are the counts of the phrase and of both parts of its weakest cut, n the words of the group, score
    floor(10^6 a a / (l r)). Phrases occur `least` times; one that lies in a longer candidate with `share` percent of its
    occurrences goes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("und")).alias("g"), F.col(f"`{text}`").cast("string").alias("text"))
    words = write_out(_words(rows), "phrase-words")
    totals = words.groupBy("g").agg(F.sum("f").alias("n"))
    words = words.where(F.col("f") >= least)
    frequent, shorter = {}, words.select("h")
    for k in range(2, longest + 1):
        below = spark.sparkContext.broadcast(make_bitmap(shorter, most_bits))
        shorter = write_out(_hashes(rows, k, below).where(F.col("f") >= least).select("h"), f"phrase-hashes-{k}")
        frequent[k] = spark.sparkContext.broadcast(make_bitmap(shorter, most_bits))
    phrases = _phrases(rows, frequent).where(F.col("f") >= least)
    levels = write_out(words.select("g", "phrase", F.lit(1).alias("words"), "f").unionByName(phrases), "phrase-levels")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = _scored(levels, longest, share).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("g", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "g").select(F.col("g").alias(group), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM split, (VALUES (1), (2), (3)) AS lengths(k) WHERE len(w) >= k),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10),
places AS (SELECT *, unnest(range(1, k)) AS i FROM candidates),
parts AS (SELECT *, array_to_string(w[1:i], ' ') AS lower_part, array_to_string(w[i + 1:k], ' ') AS upper_part FROM places),
cuts AS (
  SELECT p.lang, p.k, p.phrase, p.a, p.i, x.f AS l, y.f AS r, (1000000::HUGEINT * p.a * p.a) // (x.f::HUGEINT * y.f) AS score
  FROM parts p JOIN counts x ON x.lang = p.lang AND x.phrase = p.lower_part JOIN counts y ON y.lang = p.lang AND y.phrase = p.upper_part),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
longer AS (SELECT lang, a AS whole, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE k = 3),
held AS (SELECT lang, phrase, max(whole) AS whole FROM longer GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN held h ON b.lang = h.lang AND b.phrase = h.phrase AND b.k = 2 WHERE h.whole IS NULL OR 100 * h.whole < 50 * b.a),
ranked AS (SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank, k.phrase, k.a, k.l, k.r, t.n::BIGINT AS n, k.score::BIGINT AS score FROM kept k JOIN totals t ON k.lang = t.lang)
SELECT * FROM ranked WHERE rank <= 2000
"""
