"""The chunk table that stands in for an index: one row per document of the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions and their MIME types (fixed values).
EXTENSIONS = ["pdf", "docx", "txt", "pptx", "xlsx", "csv", "jpg", "png"]
MIME = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "txt": "text/plain",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "csv": "text/csv",
    "jpg": "image/jpeg",
    "png": "image/png",
}


def corpus(spark: SparkSession, sf_dir: str, tags: bool = False) -> DataFrame:
    """Narrow projection over documents; tags need a join with labels and are added only on request."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extension = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8 + 1).cast("int"))
    mime = F.element_at(F.create_map(*[F.lit(v) for pair in MIME.items() for v in pair]), F.col("extension"))
    out = (
        docs.withColumn("extension", extension)
        .withColumn("mime_type", mime)
        .withColumn("bucket", F.col("source"))
        .withColumn("filename", F.concat(F.lit("doc_"), F.col("doc_id") % 160, F.lit("."), F.col("extension")))
        .withColumn("object_key", F.concat_ws("/", "bucket", F.col("doc_id").cast("string"), "filename"))
        .withColumn("_id", F.concat(F.replace("object_key", F.lit("/"), F.lit("__")), F.lit("#0")))
        .withColumn("size_bytes", F.col("n_chars") * 1024)
        .withColumn("uploaded_at", F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * F.lit(37 * 60 * 1000000)))
        .withColumn("owner", F.concat(F.lit("user"), F.col("doc_id") % 7))
    )
    keep = ["doc_id", "_id", "object_key", "bucket", "filename", "extension", "mime_type", "owner", "size_bytes", "uploaded_at", F.col("lang").alias("language"), F.col("text").alias("chunk_text")]
    out = out.select(*keep)
    if tags:
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        named = labels.select(F.col("doc_id").alias("labelled"), F.array(F.concat(F.lit("quality:"), F.col("quality")), F.concat(F.lit("toxic:"), F.col("toxic"))).alias("found"))
        out = out.join(named, F.col("doc_id") == F.col("labelled"), "left").withColumn("tags", F.coalesce("found", F.array().cast("array<string>"))).drop("labelled", "found")
    return out
