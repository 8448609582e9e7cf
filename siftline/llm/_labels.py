"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm._common import write_out


def bucket(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """doc_id, y, fold, text of at most `most` labelled rows, in hash order of doc_id; the ids are few enough to broadcast."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & train)
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int"))
    )
    chosen = write_out(chosen, "labelled")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.join(F.broadcast(chosen), "doc_id")
