"""From object events to chunk rows, and upsert and delete of the chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.config import IngestConfig
from siftline.functions.text import first_filled
from siftline.schema import EVENT

# Extractable MIME types, and starts of files that give a type away (fixed values).
SUPPORTED = [
    "application/pdf",
    "application/msword",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.ms-powerpoint",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "text/plain",
    "text/html",
]
MAGIC = [("25504446", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("504B0304", "application/zip"), ("47494638", "image/gif"), ("D0CF11E0", "application/msword"), ("1F8B", "application/gzip"), ("3C21444F4354595045", "text/html"), ("3C68746D6C", "text/html")]


def decode_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """messages with `ok` (valid JSON) and `event`."""
    text = F.col(value).cast("string")
    return messages.withColumn("ok", F.try_parse_json(text).isNotNull()).withColumn("event", F.from_json(text, EVENT))


def explode_records(decoded: DataFrame) -> DataFrame:
    """One row per record of valid events: event_name, bucket, raw_key, size, content_type; events without records give none."""
    rows = decoded.where("ok").select(*[c for c in decoded.columns if c != "event"], F.explode("event.Records").alias("r"))
    return rows.select(*[c for c in rows.columns if c != "r"], F.col("r.eventName").alias("event_name"), F.col("r.s3.bucket.name").alias("bucket"), F.col("r.s3.object.key").alias("raw_key"), F.coalesce("r.s3.object.size", F.lit(0)).alias("size"), F.coalesce("r.s3.object.contentType", F.lit("application/octet-stream")).alias("content_type"))


def route(event_name: Column) -> Column:
    return F.when(event_name.startswith("s3:ObjectRemoved"), "delete").when(event_name.startswith("s3:ObjectCreated"), "ingest").otherwise("skip")


def decode_key(key: Column) -> Column:
    """Percent signs and pluses undone; what is malformed stays."""
    return F.coalesce(F.try_url_decode(key), key)


def derive(records: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """key, object_key, download_url, filename, extension, action."""
    out = records.withColumn("key", decode_key(F.col("raw_key")))
    out = out.withColumn("filename", F.element_at(F.split("key", "/"), -1)).withColumn("extension", extension_of(F.col("filename")))
    return out.withColumns({"object_key": F.concat_ws("/", "bucket", "key"), "download_url": F.concat_ws("/", F.lit(config.public_url), "bucket", "key"), "action": route(F.col("event_name"))})


def extension_of(filename: Column) -> Column:
    return F.when(filename.contains("."), F.lower(F.element_at(F.split(filename, r"\."), -1))).otherwise(F.lit(""))


def size_branch(size: Column, config: IngestConfig = IngestConfig()) -> Column:
    """ok, or too_large beyond the limit (0: no limit); oversized files go to the dead letters instead of vanishing."""
    return F.when(F.lit(config.max_file_bytes > 0) & (size > config.max_file_bytes), "too_large").otherwise("ok")


def detect_mime(content: Column, declared: Column) -> Column:
    """The declared type, or by its first bytes where that is application/octet-stream."""
    head = F.hex(F.substring(content, 1, 16))
    found = F.coalesce(*[F.when(head.startswith(m), F.lit(t)) for m, t in MAGIC])
    return F.when(declared == "application/octet-stream", F.coalesce(found, declared)).otherwise(declared)


def supported(mime: Column) -> Column:
    return mime.isin(*SUPPORTED)


def is_image(mime: Column) -> Column:
    return mime.startswith("image/")


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags removed, five entities undone, white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def extract(content: Column, mime: Column) -> Column:
    """struct(text, success, error) of text and HTML files; other types need an extractor service."""
    body = F.decode(content, "UTF-8")
    text = F.when(mime == "text/html", html_text(body)).when(mime.startswith("text/"), F.trim(body))
    error = F.when(F.length(content) == 0, F.lit("empty content")).when(text.isNull(), F.lit("unsupported type"))
    return F.struct(F.when(error.isNull(), text).alias("text"), error.isNull().alias("success"), error.alias("error"))


def metadata_columns(meta: Column, filename: Column) -> dict[str, Column]:
    """language, author, title, created, page_count of an open map; empty values fall through."""
    get = lambda k: F.element_at(meta, k)
    return {
        "language": F.coalesce(first_filled(get("Content-Language"), get("language")), F.lit("en")),
        "author": F.coalesce(first_filled(get("dc:creator"), get("Author")), F.lit("")),
        "title": F.coalesce(first_filled(get("dc:title"), get("title")), filename),
        "created": F.coalesce(first_filled(get("dcterms:created"), get("Creation-Date")), F.lit("")),
        "page_count": F.coalesce(F.coalesce(first_filled(get("meta:page-count"), get("xmpTPg:NPages")), F.lit("0")).try_cast("int"), F.lit(0)),
    }


def tags(author: Column, title: Column, pages: Column, filename: Column) -> Column:
    found = F.array(F.when(author != "", F.concat(F.lit("author:"), author)), F.when((title != "") & (title != filename), F.concat(F.lit("title:"), title)), F.when(pages != 0, F.concat(F.lit("pages:"), pages.cast("string"))))
    return F.filter(found, lambda x: x.isNotNull())


def chunk_key(object_key: Column, index: Column) -> Column:
    return F.concat(F.replace(object_key, F.lit("/"), F.lit("__")), F.lit("#"), index.cast("string"))


def empty_to_null(chunks: DataFrame) -> DataFrame:
    """Empty texts of dates and empty vectors become nulls, so an upsert keeps the old value."""
    out = {c: F.nullif(c, F.lit("")) for c in ("uploaded_at", "doc_created_at") if dict(chunks.dtypes).get(c) == "string"}
    if "embedding" in chunks.columns:
        out["embedding"] = F.when(F.size("embedding") > 0, F.col("embedding"))
    return chunks.withColumns(out) if out else chunks


def upsert(table: DataFrame, batch: DataFrame, key: str = "_id", replace_file: str | None = None, order: Column | None = None) -> DataFrame:
    """The table after a merge: new rows are added, null columns of a batch keep the old value.

    Rows of a batch without key are left out; of rows that share one, the last by `order` counts (default: the
    greatest row). replace_file names the column of the file: old rows of the batch's files that it doesn't
    rewrite go.
    """
    whole = F.struct(*[F.col(c) for c in batch.columns])
    batch = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by(whole, whole if order is None else order).alias("_row")).select("_row.*")
    new = batch.select(*[F.col(c).alias(f"n_{c}") for c in batch.columns])
    old = table
    if replace_file:
        files = batch.select(F.col(replace_file).alias("_file")).distinct()
        rewritten = old.join(files, F.col(replace_file) == F.col("_file"), "left_semi").join(batch.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")
        old = old.join(rewritten.select(F.col(key).alias("_gone")), F.col(key) == F.col("_gone"), "left_anti")
    both = old.join(new, F.col(key) == F.col(f"n_{key}"), "full")
    return both.select(*[F.coalesce(f"n_{c}", c).alias(c) if c in batch.columns else F.col(c) for c in table.columns])


def delete_by_key(table: DataFrame, gone: DataFrame, key: str = "object_key") -> DataFrame:
    return table.join(gone.select(F.col(key).alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "left_anti")


def bulk_outcome(batch: DataFrame, key: str = "_id") -> DataFrame:
    """success and failed counts of a batch: rows without key fail."""
    return batch.agg(F.count_if(F.col(key).isNotNull()).alias("success"), F.count_if(F.col(key).isNull()).alias("failed"))


def backoff_seconds(config: IngestConfig = IngestConfig()) -> list[float]:
    """Waits between attempts: doubling, capped."""
    return [min(config.retry_base_seconds * 2**i, config.retry_cap_seconds) for i in range(config.retries - 1)]
