"""Summaries of pipeline test rows, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(rows: DataFrame, slow_ms: float = 5000, dims: int = 512) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"),
        F.max_by("case_id", "latency_ms").alias("slowest"), F.min_by("case_id", "latency_ms").alias("fastest"), F.count_if(F.col("latency_ms") > slow_ms).alias("over_threshold"), F.count_if(F.col("dims") != dims).alias("wrong_dims"),
    )


def validation_flags(latency_ms: Column, dims: Column, chars: Column, image: Column, edge: Column, slow_ms: float = 5000, want: int = 512) -> Column:
    found = F.array(F.when(latency_ms > slow_ms, F.lit("WARNING: slow")), F.when(dims != want, F.lit("CRITICAL: dimensions")), F.when((chars == 0) & ~image & ~edge, F.lit("WARNING: no text")))
    return F.filter(found, lambda x: x.isNotNull())


def write_report(cases: DataFrame, folder: str) -> None:
    """The summary as JSON and as a Markdown table, and each case as JSON in folders by outcome; all by Spark's writers, so any store will do."""
    total = summary(cases)
    total.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    lines = F.array(F.lit("| measure | value |"), F.lit("|---|---|"), *[F.concat(F.lit(f"| {c} | "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(" |")) for c in total.columns])
    total.select(F.explode(lines).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/markdown")
    cases.write.mode("overwrite").partitionBy("passed").json(f"{folder}/cases")


def dump(chunks: DataFrame, folder: str) -> None:
    """Chunks as JSON lines in folders by bucket, for a look at what was indexed."""
    chunks.write.mode("overwrite").partitionBy("bucket").json(folder)
