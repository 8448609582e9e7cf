"""Recursive text chunking, and a native fixed-stride form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.schema import CHUNKS

SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Cuts in front of each separator, which stays with what follows it."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *[separator + r for r in rest]] if p]


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Joins pieces up to `size` characters; each next run starts with the last pieces that fit in `overlap`."""
    held: list[str] = []
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            yield "".join(held).strip()
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    if held:
        yield "".join(held).strip()


def split_text(text: str, size: int = 600, overlap: int = 60, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Runs of at most `size` characters, cut at the coarsest separator that occurs; finer ones inside long pieces."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    out: list[str] = []
    short: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            short.append(piece)
            continue
        out += _pack(short, size, overlap)
        short = []
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    out += _pack(short, size, overlap)
    return [o for o in out if o]


def chunk_one(text: str | None, size: int = 600, overlap: int = 60, least: int = 20) -> list[dict]:
    """Chunks of a stripped text with their places; short ones are dropped and the rest numbered anew."""
    text = (text or "").strip()
    if len(text) < least:
        return []
    found, start, last = [], 0, 0
    for piece in split_text(text, size, overlap):
        place = text.find(piece, max(0, start + last - overlap))
        place = place if place >= 0 else text.find(piece)
        start, last = place, len(piece)
        if len(piece) >= least:
            found.append((piece, place))
    return [{"text": p, "chunk_index": i, "start_char": s, "end_char": s + len(p), "total_chunks": len(found)} for i, (p, s) in enumerate(found)]


def chunk(text: Column, size: int = 600, overlap: int = 60, least: int = 20) -> Column:
    """An array of chunk structs, by Arrow batches."""

    @F.pandas_udf(CHUNKS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_one(t, size, overlap, least))

    return run(text)


def explode_chunks(docs: DataFrame, text: str, size: int = 600, overlap: int = 60, least: int = 20) -> DataFrame:
    rows = docs.withColumn("_chunk", F.explode(chunk(F.col(text), size, overlap, least))).drop(text)
    return rows.select(*[c for c in rows.columns if c != "_chunk"], F.col("_chunk.text").alias("chunk_text"), "_chunk.chunk_index", "_chunk.start_char", "_chunk.end_char", F.col("_chunk.total_chunks").alias("chunk_total"))


def fixed_stride(docs: DataFrame, text: str, size: int = 600, overlap: int = 60, least: int = 20) -> DataFrame:
    """Windows of `size` characters every size - overlap, in the JVM only."""
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(stride))
    rows = docs.select("doc_id", F.col(text).alias("_t"), F.posexplode(starts).alias("chunk_index", "start_char"))
    rows = rows.withColumn("chunk_text", F.substring("_t", F.col("start_char") + 1, F.lit(size))).drop("_t")
    return rows.where(F.length("chunk_text") >= least)
