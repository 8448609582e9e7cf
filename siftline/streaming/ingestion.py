"""The ingestion flow over a stream of object events, batch by batch and idempotent."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.config import IngestConfig, RetryPolicy
from siftline.functions.embed import embed
from siftline.operators import chunking, dead_letters, documents, exif, images, ingest
from siftline.sources.chunk_store import Alias, ChunkStore, Outcome
from siftline.sources.readers import append_json, fetch, remove

FACTS = ["object_key", "bucket", "filename", "extension", "download_url"]


def _stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")


def chunk_rows(files: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """Chunk rows of files (facts, mime, size, text): texts cut and embedded. A text too short for a chunk gives none."""
    cut = chunking.explode_chunks(files, "text", config.chunk_size, config.chunk_overlap, config.min_chunk)
    return cut.select(
        ingest.chunk_key(F.col("object_key"), F.col("chunk_index")).alias("_id"), *FACTS, F.col("mime").alias("mime_type"), F.col("size").alias("size_bytes"), "chunk_index", "chunk_total", "chunk_text",
        embed(F.col("chunk_text")).cast("array<float>").alias("embedding"), *[c for c in ("language", "tags", "author", "title", "page_count") if c in files.columns], *[F.col("created").try_cast("timestamp").alias("doc_created_at") for c in files.columns if c == "created"], F.col("timestamp").alias("uploaded_at"), F.current_timestamp().alias("indexed_at"), F.lit("ok").alias("ingestion_status"),
    )


def described(files: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """files (filename, mime, content) with `r`: struct(text, success, error), and language, author, title, page_count, created, tags.

    Texts and properties come from the files; an image's text is its caption, made of the facts in its header.
    """
    out = documents.extracted(files, ingest.extract(F.col("content"), F.col("mime"))).withColumn("_picture", F.when(ingest.is_image(F.col("mime")), F.col("content")))
    out = exif.with_image_facts(out, "_picture")
    said = lambda name: F.col(f"image.{name}")
    date = F.coalesce(said("capture_date"), said("datetime"))
    text = images.caption(F.col("filename"), said("width"), said("height"), F.col("mime"), said("camera_make"), said("camera_model"), date, said("gps_lat"), said("gps_lon"), said("user_comment"))
    error = F.coalesce(images.validation_error(F.col("content"), F.col("mime"), config), said("error"))
    image = F.struct(F.when(error.isNull(), text).alias("text"), error.isNull().alias("success"), error.alias("error"))
    out = out.withColumn("r", F.when(ingest.is_image(F.col("mime")), image).otherwise(F.col("r"))).withColumns(ingest.metadata_columns(F.col("meta"), F.col("filename")))
    return out.withColumn("tags", ingest.tags(F.col("author"), F.col("title"), F.col("page_count"), F.col("filename"))).drop("_picture", "image", "meta")


def apply_batch(messages: DataFrame, table_path: str, dead_path: str, config: IngestConfig = IngestConfig(), store: str | None = None, batch: tuple[str, int] | None = None) -> Outcome:
    """One micro-batch: deletes and upserts into the chunk table; bad messages, oversized and failed files to the dead letters, with the count of their retries.

    store: the folder of buckets that the events speak of. Its files are fetched, extracted, cut into chunks
    and embedded; a file's new chunks replace all its old ones, and files without text leave none. Without a
    store a file's facts are one row. batch: name and number that a repeated micro-batch has again; its letters and its
    commit are written once. Returns the counts of the commit.
    """
    spark = messages.sparkSession
    if "retry_count" not in messages.columns:
        messages = messages.withColumn("retry_count", F.lit(0))
    decoded = ingest.decode_events(messages)
    now = _stamp(F.current_timestamp())
    letter = lambda error: dead_letters.envelope(F.col("value"), error, F.col("bucket"), F.col("key"), now, F.col("retry_count")).alias("value")
    bad = decoded.where("NOT ok").withColumn("bucket", F.lit("")).withColumn("key", F.lit("")).select(letter(F.lit("JSONDecodeError")))
    records = ingest.derive(ingest.explode_records(decoded), config).withColumn("branch", ingest.size_branch(F.col("size"), config))
    large = records.where("action = 'ingest' AND branch = 'too_large'").select(letter(F.lit("file too large")))
    letters = bad.unionByName(large)
    # the last event of an object decides
    facts = ["action", *[c for c in FACTS if c != "object_key"], "content_type", "size", "key", "value", "retry_count", "timestamp"]
    last = records.where("action <> 'skip' AND branch = 'ok'").groupBy("object_key").agg(F.max_by(F.struct(*facts), F.struct("timestamp", "offset")).alias("e")).select("object_key", "e.*")
    created = last.where("action = 'ingest'")
    gone = last.where("action = 'delete'").select("object_key")
    replaced = aside = None
    if store is None:
        fresh = created.select(
            ingest.chunk_key(F.col("object_key"), F.lit(0)).alias("_id"), *FACTS, F.col("content_type").alias("mime_type"), F.col("size").alias("size_bytes"),
            F.lit(0).alias("chunk_index"), F.lit(1).alias("chunk_total"), F.lit("ok").alias("ingestion_status"),
        )
    else:
        read = fetch(created, store).withColumn("mime", ingest.detect_mime(F.col("content"), F.col("content_type")))
        read = described(read, config).withColumn("failed", F.coalesce("fetch_error", "r.error")).withColumn("text", F.col("r.text")).drop("content", "r")
        # files are fetched and extracted once; what they gave outlives any executor
        aside = f"{table_path.rstrip('/')}/_fetched-{uuid.uuid4().hex}"
        read.write.parquet(aside)
        read = spark.read.schema(read.schema).parquet(aside)
        letters = letters.unionByName(read.where("failed IS NOT NULL").select(letter(F.col("failed"))))
        files = read.where("failed IS NULL")
        fresh = chunk_rows(files.where("trim(text) <> ''"), config)
        gone = gone.union(files.where("trim(text) = ''").select("object_key"))
        replaced = files.where("trim(text) <> ''").select("object_key")
    if not letters.isEmpty():
        append_json(letters, dead_path, batch and f"{batch[0]}-{batch[1]}")
    table = ChunkStore(spark, Alias(spark, table_path).target() or table_path)
    outcome = table.commit(ingest.empty_to_null(fresh), gone, replaced, batch)
    if aside:
        remove(spark, aside)
    return outcome


def batch_of(df: DataFrame, kind: str, number: int) -> tuple[str, int]:
    """A name and number that only this batch of this query has: numbers begin anew with each checkpoint, and ids don't."""
    return f"{kind}-{df.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId') or 'batch'}", number


def start(messages: DataFrame, table_path: str, dead_path: str, checkpoint: str, config: IngestConfig = IngestConfig(), store: str | None = None) -> StreamingQuery:
    """Runs until the source is drained; offsets move only after a batch is in, and repeating a batch changes nothing."""
    return messages.writeStream.foreachBatch(lambda df, n: apply_batch(df, table_path, dead_path, config, store, batch_of(df, "ingest", n))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_batch(letters: DataFrame, main_path: str, dead_path: str, permanent_path: str, policy: RetryPolicy = RetryPolicy(), now: datetime | None = None, batch: str | None = None) -> None:
    """One micro-batch of dead letters: payloads whose wait is over go back to the main topic with their count, spent ones to the permanent log.

    Letters that are not due yet go back to the dead letters as they are; a letter whose time can't be read is due.
    """
    at = F.current_timestamp() if now is None else F.lit(now)
    moved = dead_letters.transition(letters, policy=policy).withColumn("due_at", dead_letters.due_at(F.col("letter.failed_at")))
    early = (F.col("action") == "retry") & F.coalesce(F.col("due_at") > at, F.lit(False))
    spent = moved.where("action = 'permanent'").select(F.to_json(F.struct("letter.*", _stamp(at).alias("logged_at"))).alias("value"))
    again = moved.where((F.col("action") == "retry") & ~early).select(F.col("letter.original_payload").alias("value"), F.col("next_count").alias("retry_count"), at.alias("timestamp"))
    append_json(again, main_path, batch)
    append_json(spent, permanent_path, batch)
    append_json(moved.where(early).select("value"), dead_path, batch)


def start_retry(letters: DataFrame, main_path: str, dead_path: str, permanent_path: str, checkpoint: str, policy: RetryPolicy = RetryPolicy(), now: datetime | None = None) -> StreamingQuery:
    return letters.writeStream.foreachBatch(lambda df, n: retry_batch(df, main_path, dead_path, permanent_path, policy, now, "{}-{}".format(*batch_of(df, "retry", n)))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reindex(spark: SparkSession, messages: DataFrame, alias: str, fresh: str, dead_path: str, checkpoint: str, config: IngestConfig = IngestConfig(), store: str | None = None) -> None:
    """Builds a second table from the earliest event on and lets the alias stand for it.

    Readers of the alias see the old table until the new one holds every event that had come; what came while it was
    built is replayed before the switch and once more after it. Events only point at objects, so replaying them is harmless.
    """
    if Alias(spark, fresh).target():
        raise ValueError(f"{fresh} is an alias")
    ChunkStore(spark, fresh).create()

    def drain() -> int:
        query = start(messages, fresh, dead_path, checkpoint, config, store)
        query.awaitTermination()
        if query.exception():
            raise query.exception()
        return ChunkStore(spark, fresh).versions()[-1]

    done = -1
    while done != (done := drain()):  # until a run finds nothing more
        pass
    Alias(spark, alias).switch(fresh)
    drain()  # what a live stream put into the old table between the last run and the switch
