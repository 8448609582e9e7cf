"""Language-model scoring by an Elias-Fano n-gram trie built in shards.

Tokens: runs without ASCII white space, A-Z lower-cased, then one end. The model is a bigram model with
a Dirichlet prior on add-one unigrams: p(w | v) = (c(v w) + A p1(w)) / (c(v) + A), p1(w) = (c(w) + 1) /
(N + V + 1); it sums to one over the known words and one unknown word.

Documents become chunks (a table of token numbers with their own vocabulary of 64-bit word hashes). A
chunk sends its distinct words and word pairs with their counts in training documents to shards by hash,
as compressed sorted keys. A shard adds the counts up, builds its part of the trie and answers the
chunk's keys; so the corpus moves once as distinct keys, any shard fits a worker, no key is hot, and
nothing of the model passes through the driver but three sums. A trie has a level of contexts and a
level of words: both are monotone sequences in Elias-Fano form, the pointers from contexts to their words
too, and the values are quantised to 16 bits; a pair is found by successor search in the context, then
in the range of its words. The buffers are flat and can be memory-mapped from a file.

Edge cases: a null or empty text is one end token; rows without doc_id are scored, neither held out nor
learned from; repeated rows count as often as they are there; without training rows every count is 0;
columns other than doc_id and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm._common import hashes_of, mix, slices, sum_of, text_array, words_of, write_out
from siftline.llm._labels import bucket

PRIOR = 300.0
CHUNK_BYTES = 12 << 20
#: Distinct keys of all chunks together that one shard takes, on average.
SHARD_KEYS = 500_000
END, START = np.uint64(0x656E64), np.uint64(0x7374617274)
STEP = 2000.0


class EliasFano:
    """A non-decreasing sequence of integers: low bits packed as they are, high bits in unary, with sampled select."""

    def __init__(self, values: np.ndarray, universe: int | None = None):
        values = values.astype(np.uint64)
        self.n = len(values)
        self.universe = int(universe if universe is not None else (values[-1] + np.uint64(1) if self.n else 1))
        self.low_bits = max(0, (self.universe // max(self.n, 1)).bit_length() - 1)
        shift = np.uint64(self.low_bits)
        high = (values >> shift).astype(np.int64)
        ones = high + np.arange(self.n)
        bits = np.zeros((self.universe >> self.low_bits) + self.n + 2, np.uint8)
        bits[ones] = 1
        self.high = np.packbits(bits, bitorder="little")
        low = values & ((np.uint64(1) << shift) - np.uint64(1))
        if self.low_bits:
            spread = (low[:, None] >> np.arange(self.low_bits, dtype=np.uint64)) & np.uint64(1)
            self.low = np.packbits(spread.astype(np.uint8).ravel(), bitorder="little")
        else:
            self.low = np.zeros(0, np.uint8)
        self._open()

    def _open(self) -> None:
        """The start of each high bucket, from the unary bits: bucket h holds positions starts[h] to starts[h + 1]."""
        bits = np.unpackbits(self.high, bitorder="little")
        zeros = np.flatnonzero(bits == 0)[: (self.universe >> self.low_bits) + 2]
        self.starts = np.concatenate([[0], zeros - np.arange(len(zeros))])

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        high = np.searchsorted(self.starts, i, side="right") - 1
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        first = i.astype(np.int64) * self.low_bits
        for b in range(self.low_bits):
            where = first + b
            out |= ((self.low[where >> 3] >> (where & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return out

    def successor(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | None = None) -> np.ndarray:
        """For each x the first position in [begin, end) whose value is at least x, or end."""
        last = np.full(len(x), self.n) if end is None else end
        high = np.minimum((x >> np.uint64(self.low_bits)).astype(np.int64), len(self.starts) - 2)
        lo, hi = np.maximum(self.starts[high], begin), np.minimum(self.starts[high + 1], last)
        hi = np.maximum(lo, hi)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return np.minimum(np.maximum(lo, begin), last)
            middle = (lo[open_] + hi[open_]) >> 1
            less = self.at(middle) < x[open_]
            lo[open_[less]] = middle[less] + 1
            hi[open_[~less]] = middle[~less]

    def buffers(self) -> list[np.ndarray]:
        return [np.array([self.n, self.universe, self.low_bits], np.int64), self.high, self.low]

    @classmethod
    def from_buffers(cls, head: np.ndarray, high: np.ndarray, low: np.ndarray) -> EliasFano:
        self = cls.__new__(cls)
        self.n, self.universe, self.low_bits = (int(v) for v in head)
        self.high, self.low = high, low
        self._open()
        return self


def quantise(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of 16 bits; small counts come back exactly after rounding, those beyond the scale as its greatest."""
    return np.minimum(np.rint(np.log2(np.maximum(counts, 1).astype(float)) * STEP), 0xFFFF).astype(np.uint16)


def restore(codes: np.ndarray) -> np.ndarray:
    return np.exp2(codes / STEP)


class PairTrie:
    """Contexts (32 bits), pointers, words within a context (32 bits), quantised values of 64-bit keys context << 32 | word."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        context, first = np.unique(keys >> np.uint64(32), return_index=True)
        self.contexts = EliasFano(context, 1 << 32)
        self.pointers = EliasFano(np.append(first, len(keys)).astype(np.uint64), len(keys) + 1)
        rank = np.repeat(np.arange(len(context), dtype=np.uint64), np.diff(np.append(first, len(keys))))
        # words restart in each context; with the context's rank in front the whole level is monotone
        self.words = EliasFano((rank << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF)), max(len(context), 1) << 32)
        self.values = quantise(counts)

    def look(self, keys: np.ndarray) -> np.ndarray:
        """Quantised value + 1 of each key, 0 where the trie has no such pair."""
        out = np.zeros(len(keys), np.uint16)
        if not len(self.values) or not len(keys):
            return out
        context = keys >> np.uint64(32)
        rank = self.contexts.successor(context)
        safe = np.minimum(rank, self.contexts.n - 1)
        known = (rank < self.contexts.n) & (self.contexts.at(safe) == context)
        at = np.flatnonzero(known)
        rank = rank[at]
        begin, end = self.pointers.at(rank).astype(np.int64), self.pointers.at(rank + 1).astype(np.int64)
        target = (rank.astype(np.uint64) << np.uint64(32)) | (keys[at] & np.uint64(0xFFFFFFFF))
        place = self.words.successor(target, begin, end)
        hit = np.flatnonzero(place < end)
        same = self.words.at(place[hit]) == target[hit]
        out[at[hit[same]]] = np.minimum(self.values[place[hit[same]]].astype(np.int64) + 1, 65535)
        return out

    def save(self, path: str) -> None:
        """One flat file: lengths, then buffers."""
        parts = [b for level in (self.contexts, self.pointers, self.words) for b in level.buffers()] + [self.values]
        with open(path, "wb") as f:
            np.array([p.nbytes for p in parts], np.int64).tofile(f)
            for p in parts:
                f.write(p.tobytes())
                f.write(b"\0" * (-p.nbytes % 8))

    @classmethod
    def open(cls, path: str) -> PairTrie:
        """Maps a saved trie into memory."""
        whole = np.memmap(path, np.uint8, "r")
        sizes = whole[:80].view(np.int64)
        parts, at = [], 80
        for n in sizes:
            parts.append(whole[at : at + int(n)])
            at += int(n) + -int(n) % 8
        self = cls.__new__(cls)
        levels = [EliasFano.from_buffers(parts[i].view(np.int64), parts[i + 1], parts[i + 2]) for i in (0, 3, 6)]
        self.contexts, self.pointers, self.words = levels
        self.values = parts[9].view(np.uint16)
        return self


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """context << 32 | word; the word's half depends on the whole context, so equal keys are equal pairs up to 64-bit chance."""
    return (mix(context) & ~np.uint64(0xFFFFFFFF)) | (mix(context * np.uint64(0x100000001B3) + word) & np.uint64(0xFFFFFFFF))


def pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def unpack(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def lower_ascii(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased. The texts are copied first: ascii_lower misreads arrays that start inside a larger buffer."""
    return pc.ascii_lower(texts.take(pa.array(np.arange(len(texts)))))


def chunks_of(docs: DataFrame, train: str = "train") -> DataFrame:
    """chunk, doc_ids, train flags, token ends, tokens (numbers of the chunk's words), words (sorted hashes), n_keys."""
    schema = "chunk string, doc_ids array<string>, train array<boolean>, held array<boolean>, ends binary, tokens binary, words binary, n_keys long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=CHUNK_BYTES):
            codes, offsets, distinct = words_of(lower_ascii(text_array(batch.column(3))))
            hashes = hashes_of(distinct)
            ends = offsets[1:] + np.arange(1, len(offsets))
            vocabulary, number = np.unique(np.append(hashes, END), return_inverse=True)
            tokens = np.full(ends[-1], number[-1], np.uint32)
            inner = np.ones(len(tokens), bool)
            inner[ends - 1] = False
            tokens[inner] = number[codes]
            row = [uuid.uuid4().hex], [batch.column(0).cast(pa.string()).to_pylist()], [batch.column(1).to_pylist()], [batch.column(2).to_pylist()], [pack(ends)], [pack(tokens)], [pack_sorted(vocabulary)], [len(tokens) + len(vocabulary)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["chunk", "doc_ids", "train", "held", "ends", "tokens", "words", "n_keys"])

    return docs.mapInArrow(run, schema)


def chunk_pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one chunk: vocabulary, tokens, ends, and the number of the word before each token (one past the vocabulary at a start)."""
    vocabulary, tokens, ends = unpack_sorted(row["words"]), unpack(row["tokens"], np.uint32).astype(np.int64), unpack(row["ends"], np.int64)
    before = np.concatenate([[0], tokens[:-1]])
    before[np.concatenate([[0], ends[:-1]])] = len(vocabulary)
    return vocabulary, tokens, ends, before


def distinct_pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pair keys of a chunk, the number of each token's pair, and the vocabulary with START after it."""
    vocabulary, tokens, _, before = chunk_pairs(row)
    known = np.append(vocabulary, START)
    pairs, number = np.unique((before << 32) | tokens, return_inverse=True)
    keys = pair_keys(known[pairs >> 32], known[pairs & 0xFFFFFFFF])
    keys, again = np.unique(keys, return_inverse=True)
    return keys, again[number], known


def shard_rows(chunks: DataFrame, shards: int) -> DataFrame:
    """shard, kind (1 words, 2 pairs), chunk, keys, counts (in training documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, tokens, ends, _ = chunk_pairs(row)
                learn = np.repeat(np.array([bool(t) for t in row["train"]]), np.diff(np.concatenate([[0], ends])))
                pairs, number, known = distinct_pairs(row)
                starts = np.array([sum(map(bool, row["train"]))])
                order = np.argsort(known, kind="stable")
                single = np.concatenate([np.bincount(tokens[learn], minlength=len(vocabulary)), starts])[order]
                for kind, keys, counts in ((1, known[order], single), (2, pairs, np.bincount(number[learn], minlength=len(pairs)))):
                    # shards by a hash of the key; the keys of a shard stay sorted
                    shard = (mix(keys) % np.uint64(shards)).astype(np.int64)
                    by = np.argsort(shard, kind="stable")
                    cut = np.searchsorted(shard[by], np.arange(shards + 1))
                    parts = [(s, by[a:b]) for s, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s for s, _ in parts], pa.int32()), pa.array([kind] * len(parts), pa.int32()), pa.array([row["chunk"]] * len(parts)), pa.array([pack_sorted(keys[i]) for _, i in parts], pa.binary()), pa.array([pack(counts[i].astype(np.int64)) for _, i in parts], pa.binary())],
                        names=["shard", "kind", "chunk", "keys", "counts"],
                    )

    return chunks.select("chunk", "train", "ends", "tokens", "words").mapInArrow(run, "shard int, kind int, chunk string, keys binary, counts binary")


def answer_shard(frame: pd.DataFrame) -> pd.DataFrame:
    """Adds up one shard, builds its trie and answers every chunk: exact counts of words, trie codes of pairs."""
    shard, kind = frame["shard"].iloc[0], frame["kind"].iloc[0]
    asked = [unpack_sorted(k) for k in frame["keys"]]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.concatenate([unpack(c, np.int64) for c in frame["counts"]]))
    seen = total > 0
    if kind == 2:
        trie = PairTrie(keys[seen], total[seen])
        answers = [pack(trie.look(k)) for k in asked]
        n = v = 0
    else:
        answers = [pack(total[np.searchsorted(keys, k)]) for k in asked]
        real = seen & (keys != START)
        n, v = int(total[real].sum()), int(real.sum())
    out = pd.DataFrame({"chunk": frame["chunk"], "shard": shard, "kind": kind, "answer": answers})
    out["n"], out["v"] = 0, 0
    out.loc[out.index[:1], ["n", "v"]] = n, v
    return out


def score_chunk(row: dict, answers: list[dict], shards: int, n_train: int, n_words: int, prior: float) -> pd.DataFrame:
    vocabulary, tokens, ends, before = chunk_pairs(row)
    pairs, number, known = distinct_pairs(row)
    got = {(a["kind"], a["shard"]): a["answer"] for a in answers}

    def gather(kind: int, keys: np.ndarray, dtype: type) -> np.ndarray:
        shard = (mix(keys) % np.uint64(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        out = np.zeros(len(keys), dtype)
        cut = np.searchsorted(shard[by], np.arange(shards + 1))
        for s, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            if b > a:
                out[by[a:b]] = unpack(got[(kind, s)], dtype)
        return out

    order = np.argsort(known, kind="stable")
    single = np.zeros(len(known), np.int64)
    single[order] = gather(1, known[order], np.int64)
    codes = gather(2, pairs, np.uint16)
    both = np.where(codes > 0, restore(codes.astype(float) - 1), 0.0)
    one = (single[tokens] + 1.0) / (n_train + n_words + 1.0)
    smooth = (both[number] + prior * one) / (single[before] + prior)
    offsets = np.concatenate([[0], ends])
    return pd.DataFrame({
        "doc_id": pd.array([None if i is None else int(i) for i in row["doc_ids"]], "Int64"), "held_out": [bool(h) for h in row["held"]], "n_tokens": np.diff(offsets), "n_known": sum_of((single[tokens] > 0).astype(np.int64), offsets),
        "train_tokens": n_train, "base_score": sum_of(np.log10(one), offsets), "score": sum_of(np.log10(smooth), offsets),
    })


def score_documents(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """Scores rows (doc_id, train, held, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    chunks = write_out(chunks_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "train", "held", F.col("text").cast("string").alias("text"))), "token-chunks")
    keys = chunks.agg(F.coalesce(F.sum("n_keys"), F.lit(0)).alias("n")).first()["n"]
    shards = max(4, -(-keys // SHARD_KEYS))
    answers = shard_rows(chunks, shards).groupBy("shard", "kind").applyInPandas(answer_shard, "chunk string, shard int, kind int, answer binary, n long, v long")
    answers = write_out(answers, "trie-answers")
    sums = answers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n_train, n_words = sums["n"], sums["v"]

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return score_chunk(left.iloc[0].to_dict(), right.to_dict("records"), shards, n_train, n_words, prior)

    theirs = answers.select(F.col("chunk").alias("of"), "shard", "kind", "answer")
    return chunks.drop("n_keys", "train").groupBy("chunk").cogroup(theirs.groupBy("of")).applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(bucket("doc_id", 7) == 2, F.lit(False))
    learn = F.coalesce(bucket("doc_id", 7) != 2, F.lit(False))
    return score_documents(docs.withColumn("held", held).withColumn("train", learn))
