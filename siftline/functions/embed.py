"""A deterministic text embedding: hashed words, L2-normalised. Models plug in as the same kind of UDF."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import analyze

DIMENSION = 64


def slot_of(word: str, dimension: int = DIMENSION) -> int:
    """The component (slot // 2) and sign (even: +) of a word: its MD5's first 16 bits."""
    return int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % (2 * dimension)


def unit_rows(words: pa.Array, dimension: int = DIMENSION) -> np.ndarray:
    """The vectors of lists of words; each distinct word of the batch is hashed once."""
    # one word before the others keeps the dictionary from being empty
    flat = pa.chunked_array([pa.array(["-"]), words.flatten().cast(pa.string())]).combine_chunks().dictionary_encode()
    slots = np.fromiter((slot_of(w, dimension) for w in flat.dictionary.to_pylist()), np.int64, len(flat.dictionary))
    codes = flat.indices.to_numpy(zero_copy_only=False)[1:]
    sizes = np.zeros(len(words), np.int64) if not len(words) else np.nan_to_num(np.asarray(words.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    row = np.repeat(np.arange(len(words)), sizes)
    counts = np.bincount(row * (2 * dimension) + slots[codes], minlength=2 * dimension * len(words)).reshape(-1, dimension, 2)
    out = (counts[:, :, 0] - counts[:, :, 1]).astype(float)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(length > 0, length, 1)


def embed(text: Column, dimension: int = DIMENSION, most_chars: int | None = None) -> Column:
    """array<double> of a text; a blank text is the zero vector. Words are cut in the JVM, counted in Arrow batches."""

    @F.arrow_udf("array<double>")
    def vectors(words: pa.Array) -> pa.Array:
        rows = unit_rows(words, dimension)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * dimension, pa.int32()), pa.array(rows.ravel()))

    return vectors(analyze(F.coalesce(text if most_chars is None else F.substring(text, 1, most_chars), F.lit(""))))
