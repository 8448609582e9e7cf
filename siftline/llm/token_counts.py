"""Token counts without token ids.

Each distinct pre-token of a slice of documents is counted once by the tokenizer's own BPE; the counts
are joined by dictionary code to the documents' pre-token occurrences and summed. A pre-token here is a
maximal run without ASCII white space: the tokenizer's normaliser and splitter never join pieces across
white space, so counts over such runs add up exactly, special strings inside included.

Edge cases: a null or empty text has 0 tokens and 0 bytes; a null doc_id is kept; repeated rows give
repeated results; columns other than doc_id and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm._common import slices, sum_of, text_array, words_of

#: Distinct pre-tokens whose counts a Python worker keeps; beyond it the memory starts anew (results don't change).
KEEP = 400_000

LIMIT = 2048


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Pieces of each distinct pre-token, counted once while it is remembered."""

    def __init__(self, path: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keep, self.known = keep, {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.keep:
            known.clear()
        fresh = [w for w in words if w not in known]
        for a in range(0, len(fresh), 20_000):
            part = fresh[a : a + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = len(e)
        return np.fromiter((known[w] for w in words), np.int64, len(words))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, n_bytes, n_tokens, over_limit (n_tokens > limit). No shuffle: one scan of two columns."""
    path = path or tokenizer_path()
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in slices(batches):
            counter = counter or PieceCounter(path)
            texts = text_array(batch.column(1))
            codes, offsets, distinct = words_of(texts)
            pieces = counter.of(distinct.to_pylist())
            tokens = sum_of(pieces[codes] if len(codes) else codes, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
