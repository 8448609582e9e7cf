"""Dedup of hits, pages, facets and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(hits: DataFrame, key: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first hit of each key. Partitions are keys of hits, already cut to a pool."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def best_per(hits: DataFrame, key: list[str], score: str, tie: str) -> DataFrame:
    """The hit with the greatest score of each key (ties: least `tie`), by an aggregate that combines before the shuffle."""
    rest = [c for c in hits.columns if c not in key]
    best = hits.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(tie))).alias("best"))
    return best.select(*key, *[F.col(f"best.{c}").alias(c) for c in rest])


def worker_dedup(hits: DataFrame, score: str = "combined") -> DataFrame:
    """One hit per file name, best first; the same name in two buckets is one file."""
    return first_per(hits, [F.coalesce(F.nullif("filename", F.lit("")), F.nullif("object_key", F.lit("")), F.col("_id"))], [F.desc(score), "filename", "doc_id"])


def gateway_dedup(hits: DataFrame, score: str = "combined") -> DataFrame:
    """One hit per bucket and file name, best first."""
    return first_per(hits, ["bucket", "filename"], [F.desc(score), "doc_id"])


def page(rows: DataFrame, order: list[Column | str], size: int, start: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(start).limit(size)


def facet(matches: DataFrame, field: str, size: int) -> DataFrame:
    """key and count of the most frequent values."""
    return matches.groupBy(F.col(field).alias("key")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key").limit(size)


def facets(matches: DataFrame, sizes: tuple[tuple[str, int], ...]) -> dict[str, DataFrame]:
    return {f: facet(matches, f, n) for f, n in sizes}


def total_size(matches: DataFrame) -> DataFrame:
    return matches.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size"))


def type_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy(F.lower(F.coalesce(F.nullif("extension", F.lit("")), F.lit("unknown"))).alias("kind")).agg(F.count("*").alias("n"))


def index_stats(chunks: DataFrame) -> DataFrame:
    """Rows and stored text bytes of the chunk table."""
    return chunks.agg(F.count("*").alias("doc_count"), F.coalesce(F.sum(F.octet_length("chunk_text")), F.lit(0)).alias("text_bytes"))


def same_names(before: DataFrame, after: DataFrame) -> bool:
    """Whether two listings hold the same names: what a live view polls for."""
    a, b = (df.select("filename").distinct() for df in (before, after))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
